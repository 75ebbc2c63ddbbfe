"""Typed errors; permissive jobs carry code and message as columns instead."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from contextlib import contextmanager


class ImageError(Exception):
    def __init__(self, code: str, message: str, **details) -> None:
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.details = code, message, details


@contextmanager
def typed(code: str, name: str = "") -> Iterator[None]:
    """What malformed content raises inside becomes an ImageError of this code."""
    try:
        yield
    except ImageError:
        raise
    except (struct.error, zlib.error, ValueError, LookupError, OverflowError, TypeError, EOFError) as e:
        raise ImageError(code, f"{name}{': ' if name else ''}{type(e).__name__}: {e}") from e
