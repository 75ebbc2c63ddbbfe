"""First-fit decreasing packing of token sequences, in randomised groups of documents.

Documents are tokenised and cut into pieces of the sequence length; a last, shorter piece is what has to be packed. Pieces
are dealt into groups at random, of about `group_pieces` pieces however large the table is, and each group is
packed by itself: pieces from the longest on go to the first bin with room. A tournament tree over the bins holds the room
of each bin and, at each inner node, the larger of its two children's, so the first bin with enough room is found by one way down.

Bins that end up far from full are taken apart: from the last opened on, their pieces are cut to fill the room of others, where
that room is at least `least_cut`. What is left at the end is cut into sequences whose lengths are powers of two, as these
aren't padded. A group thus pads less than `least_cut` for each of its sequences.

Defined results: a null text is empty, and an empty text has the end token only; repeated rows are packed each; a null doc_id
stays null; ties in length go to the piece of the earlier row (rows are numbered as read) and the earlier place; a
long text becomes many pieces, dealt over all groups; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batches_of, by_groups, materialize, pieces
from .vocab import BYTE_BPE, ByteLevel, default_path, file_bytes, shipped

LENGTH, GROUP_PIECES, LEAST_CUT, SEED = 1024, 4096, 16, 13
PIECES = "row long, doc_id long, start long, length long, doc_tokens long, crc long, ids binary"
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Bins in the order they were opened; the first with enough room is found in log(bins) steps."""

    def __init__(self, bins: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [0] * (2 * self.leaves)

    def set(self, b: int, room: int) -> None:
        at = self.leaves + b
        self.room[at] = room
        while at > 1:
            at >>= 1
            most = max(self.room[2 * at], self.room[2 * at + 1])
            if self.room[at] == most:
                break
            self.room[at] = most

    def first(self, need: int) -> int | None:
        if self.room[1] < need:
            return None
        at = 1
        while at < self.leaves:
            at = 2 * at if self.room[2 * at] >= need else 2 * at + 1
        return at - self.leaves


def first_fit(lengths: Sequence[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; items come longest first."""
    tree, bins = Tournament(len(lengths)), []
    left = []
    for i, n in enumerate(lengths):
        b = tree.first(n)
        if b is None:
            b = len(bins)
            bins.append([])
            left.append(capacity)
        bins[b].append(i)
        left[b] -= n
        tree.set(b, left[b])
    return bins


def powers(n: int) -> list[int]:
    """The powers of two that n is the sum of, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def padded(n: int, capacity: int) -> int:
    return 0 if n & (n - 1) == 0 else capacity - n


def pack(lengths: Sequence[int], capacity: int = LENGTH, least_cut: int = LEAST_CUT) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start in the item, length), for items that come longest first."""
    bins = [[(i, 0, lengths[i]) for i in b] for b in first_fit(lengths, capacity)]
    used = [sum(p[2] for p in b) for b in bins]
    # The emptiest bins, the last opened first, give their pieces to the others as long as there is room worth a cut.
    order = sorted((b for b in range(len(bins)) if padded(used[b], capacity)), key=lambda b: (-used[b], b))
    rest: list[tuple[int, int, int]] = []
    k = 0
    while k < len(order):
        b = order[k]
        room = capacity - used[b]
        if room < least_cut:
            k += 1
            continue
        while room and (rest or k < len(order) - 1):
            if not rest:
                last = order.pop()
                rest, bins[last] = bins[last], []
            i, s, n = rest.pop()
            take = min(room, n)
            bins[b].append((i, s, take))
            room -= take
            if take < n:
                rest.append((i, s + take, n - take))
        if room:  # nothing is left to fill it with
            rest, bins[b] = bins[b], []
            break
        k += 1
    out = [b for b in bins if b]
    for size in powers(sum(p[2] for p in rest)):
        out.append([])
        while size:
            i, s, n = rest.pop()
            take = min(size, n)
            out[-1].append((i, s, take))
            size -= take
            if take < n:
                rest.append((i, s + take, n - take))
    return out


def id_type(data: bytes) -> str:
    return "<u2" if max(ByteLevel(data, plain=False).bytes) < 1 << 16 else "<u4"


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def token_pieces(docs: DataFrame, vocabulary: str, *, length: int = LENGTH, end_id: int = 0) -> DataFrame:
    """Documents' ids, end token included, cut at the sequence length: full pieces have their checksum, others their ids."""
    files, kind = shipped(docs.sparkSession, vocabulary), id_type(file_bytes(vocabulary))
    schema = arrow_schema(PIECES)

    def run(it):
        tokens = ByteLevel(files.value[0], plain=False)

        def rows() -> Iterator[tuple]:
            for b in pieces(it):
                for row, doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
                    ids = np.asarray([*(tokens.encode(text) if text else ()), end_id], kind)
                    for s in range(0, len(ids), length):
                        cut = ids[s : s + length]
                        full = len(cut) == length
                        yield row, doc_id, s, len(cut), len(ids), crc32(cut) if full else None, None if full else cut.tobytes()

        yield from batches_of(rows(), schema, 1024)

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def first_fit_packing(docs: DataFrame, *, vocabulary: str | None = None, length: int = LENGTH, end_id: int = 0, least_cut: int = LEAST_CUT, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: its place in its document, the checksum of its ids, its sequence and its place there."""
    vocabulary = vocabulary or default_path(BYTE_BPE)
    kind = id_type(file_bytes(vocabulary))
    cut = materialize(token_pieces(docs, vocabulary, length=length, end_id=end_id), "token-pieces")
    groups = max(1, -(-cut.count() // group_pieces))

    def each(key: int, t) -> Iterator[tuple]:
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("row", "start", "doc_id", "length", "doc_tokens", "crc", "ids"))), key=lambda r: (-r[3], r[0], r[1]))
        whole = sum(r[3] == length for r in rows)
        rest = rows[whole:]
        held = [np.frombuffer(r[6], kind) for r in rest]
        sequence = int(key) << 32
        for _, start, doc_id, n, total, crc, _ in rows[:whole]:
            yield doc_id, start, n, crc, total, sequence, 0
            sequence += 1
        for bin_ in pack([r[3] for r in rest], length, least_cut):
            offset = 0
            for i, s, n in bin_:
                yield rest[i][2], rest[i][1] + s, n, crc32(held[i][s : s + n]), rest[i][4], sequence, offset
                offset += n
            sequence += 1

    keyed = cut.withColumn("key", F.pmod(F.xxhash64("row", "start", F.lit(SEED)), F.lit(groups)))
    return by_groups(keyed, each, OUT)
