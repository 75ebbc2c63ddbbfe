"""Variable-capacity best-fit packing of token sequences.

Documents are cut into pieces of at most the largest permitted length. Pieces,
largest first, go to the open bin with the least room that still holds them;
else a bin is opened. Its size is the permitted length with the least cost per
token it would hold, judged jointly with the pieces still to be packed: what remains is
put into a trial bin of each size, largest first, and the cost is divided by what
it holds then. At the end each bin is shrunk to the least-cost permitted length
that holds its contents. Packing runs independently in shards of about
`shard_docs` documents, so its loss is one partly filled bin of each size a shard.

The cost of a bin defaults to what a training step costs: something a sequence, its
length, and attention, which grows with the square of the length.

Defined results: documents without tokens get one row with a null bin; repeated
rows are packed each, and many of them are spread over shards; ties go to the smaller
doc_id (null last) and the earlier piece, ties between sizes to the shorter one, ties between
bins to the one last used; a null doc_id is kept as null; a very long text becomes many
pieces; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_groups, materialize
from .mixing import word_count

SIZES = (256, 512, 1024, 2048, 4096)
OUT = "doc_id long, piece int, start long, n_tokens long, bin_id long, bin_size int, bin_offset int"
#: Equal rows that go to one shard together.
TOGETHER = 64


def linear_cost(overhead: int = 16) -> Callable[[int], float]:
    """A bin costs its length and a fixed amount."""
    return lambda size: size + overhead


def attention_cost(overhead: int = 32, width: int = 16384) -> Callable[[int], float]:
    """A fixed amount a sequence, its length, and the square of its length over `width`."""
    return lambda size: overhead + size + size * size / width


class Remaining:
    """How many pieces of each length are still to be packed."""

    def __init__(self, items: Sequence[int]) -> None:
        self.count = Counter(n for n in items if n)
        self.lengths = 0  # bit n: there is a piece of length n
        for n in self.count:
            self.lengths |= 1 << n

    def take(self, n: int) -> None:
        if n:
            self.count[n] -= 1
            if not self.count[n]:
                self.lengths &= ~(1 << n)

    def fill(self, room: int) -> int:
        """How much of the room a trial bin fills, largest first."""
        left, lengths = room, self.lengths
        while left and (fit := lengths & ((2 << left) - 1)):
            n = fit.bit_length() - 1
            left -= n * min(self.count[n], left // n)
            lengths = fit ^ (1 << n)
        return room - left


def pack(items: Sequence[int], sizes: Sequence[int] = SIZES, cost: Callable[[int], float] | None = None) -> tuple[list[int], list[int], list[int], list[int]]:
    """(bin of each item, offset of each item, opening size and final size of each bin) for items in the given order, none longer than max(sizes)."""
    cost = cost or attention_cost()
    sizes = sorted(set(sizes))
    left = Remaining(items)
    stacks: dict[int, list[int]] = {}
    rooms = 0  # bit r: some open bin has r tokens of room
    where, offset, used, opened = [], [], [], []
    for n in items:
        left.take(n)
        fit = rooms >> n
        if fit and n:
            room = n + (fit & -fit).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
        else:
            b = len(used)
            room = min((s for s in sizes if s >= n), key=lambda s: (cost(s) / max(1, n + left.fill(s - n)), s))
            used.append(0)
            opened.append(room)
        where.append(b)
        offset.append(used[b])
        used[b] += n
        if room > n:
            stacks.setdefault(room - n, []).append(b)
            rooms |= 1 << (room - n)
    final = [min((s for s in sizes if s >= u), key=lambda s: (cost(s), s)) for u in used]
    return where, offset, opened, final


def best_fit_packing(docs: DataFrame, *, tokens: Column | None = None, sizes: Sequence[int] = SIZES, cost: Callable[[int], float] | None = None, shard_docs: int = 16384) -> DataFrame:
    """One row per piece: where it starts in its document, its bin, the bin's length, its offset there."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (tokens if tokens is not None else word_count()).cast("long").alias("n"))
    # Equal rows are counted before the shuffle and dealt out in parts, so one that repeats very often is split.
    sized = materialize(sized.groupBy("doc_id", "n").agg(F.count("*").alias("c")), "sizes")
    n_shards = max(1, -(-int(sized.agg(F.sum("c")).first()[0] or 0) // shard_docs))
    top = max(sizes)

    def each(key, t) -> Iterator[tuple]:
        pieces = []
        for d, n, times in zip(*(t.column(c).to_pylist() for c in ("doc_id", "n", "times"))):
            for _ in range(times):
                if not n:
                    yield d, 0, 0, 0, None, None, None
                pieces += [(min(top, n - s), d, s) for s in range(0, n, top)]
        pieces.sort(key=lambda p: (-p[0], p[1] is None, p[1] or 0, p[2]))
        where, offset, _, final = pack([p[0] for p in pieces], sizes, cost)
        for (n, d, s), b, o in zip(pieces, where, offset):
            yield d, s // top, s, n, (int(key) << 32) + b, final[b], o

    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1, F.lit(TOGETHER).cast("long")))
    dealt = sized.withColumn("at", parts).withColumn("times", F.least(F.lit(TOGETHER).cast("long"), F.col("c") - F.col("at")))
    keyed = dealt.select("doc_id", "n", "times", F.pmod(F.xxhash64("doc_id", "n", "at"), F.lit(n_shards)).alias("key"))
    return by_groups(keyed, each, OUT)
