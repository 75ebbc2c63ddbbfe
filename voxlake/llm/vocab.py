"""Public tokenizers as tasks get them: the bytes of a vocabulary file, read on the driver.

The path of the files is a parameter; its default is where the package `public_tokenizers` keeps them.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import SparkSession

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def file_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def shipped(spark: SparkSession, *paths: str):
    """A broadcast of the files' bytes: a fixed size, whatever the corpus."""
    return spark.sparkContext.broadcast(tuple(map(file_bytes, paths)))


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, by the rule of that format."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}


class ByteLevel:
    """A byte-level BPE from the bytes of its JSON file: ids of a text, and what each id stands for.

    Where ids count the merges up, as in the public files, the merges are ranks and the faster of the two installed
    encoders takes them; else the JSON's own library encodes. Texts that hold a special token's string go to the JSON's
    library unless such strings are plain text.
    """

    def __init__(self, data: bytes, *, plain: bool) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(data)
        letters = byte_letters()
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in specials}
        self.bytes |= {i: t.encode() for t, i in specials.items()}
        self.slow = Tokenizer.from_buffer(data)
        self.slow.encode_special_tokens = plain
        self.specials = [] if plain else list(specials)
        merged = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        ranked = all(spec["model"]["vocab"]["".join(m)] == 256 + n for n, m in enumerate(merged))
        self.fast = None
        if ranked:
            ranks = {b: i for i, b in self.bytes.items() if i < 256 + len(merged)}
            self.fast = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.specials):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def sized(table: dict[int, bytes] | list[bytes]) -> np.ndarray:
    """Bytes of each id."""
    items = table.items() if isinstance(table, dict) else enumerate(table)
    out = np.zeros(max(table, default=-1) + 1 if isinstance(table, dict) else len(table), np.int64)
    for i, b in items:
        out[i] = len(b)
    return out


def piece_encoder(data: bytes) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes]]:
    """A piece model's encoder of lists of texts, and the bytes of each of its pieces: U+2581 is a space, <0xHH> a byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    held = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))]
    return (lambda texts: model.encode(texts, num_threads=1)), held
