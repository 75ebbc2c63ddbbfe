"""Every registered query of the image engine, with its SQL."""

from __future__ import annotations

from . import frame_queries, metadata_queries, volume_queries

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _family in (frame_queries, volume_queries, metadata_queries):
    QUERIES |= _family.QUERIES
    SQL |= _family.SQL
