"""Repeated word windows by compressed FM-indexes.

A window is `width` consecutive words of one document; the operator finds every
window whose word sequence starts at two places or more.

Only windows that can be repeated are indexed. The anchor of a window is its
smallest 8-word gram by hash, so equal windows have equal anchors; an anchor that
stands at one place only ends the matter for its windows. Windows in a row with the
same anchor form a segment. Equal segments of different places are one row with a
count, and segments are dealt into shards by anchor, so equal windows always meet in one
shard. Where more than `bound` places share an anchor, its windows are keyed by
a hash of the whole window instead, which spreads a passage that a third of all
documents hold; a count by that hash leaves those at two places or more to the index. The
bound changes the path, not the result.

A shard's segments form one text over its own word numbers; its Burrows-Wheeler
transform is kept in a wavelet matrix of packed bit vectors. Segments are
streamed through backward search, a whole shard at a time: the matching
statistics say how far back from a place a segment still occurs twice or more
(occurrences weighted by the segments' counts), and spans of at least `width` words
are reported. Words are compared by 64-bit hashes.

Byte-identical texts are one text with a count.

Defined results: a null text has no words; texts of fewer than `width` words
lose none; very long texts are taken whole; a null doc_id is kept; repeated rows count as further places, so
rows that repeat lose all their windows' words; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batches_of, bit_filter, by_groups, few_rows_a_batch, grams, hash64, hash_words, in_filter, map_rows, materialize, pieces, release, words_of

WIDTH = 35
GRAM = 8
SHARD_WORDS = 1 << 16


# ---------------------------------------------------------------- anchors


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Place of the leftmost smallest value of each w consecutive values."""
    n = len(x) - w + 1
    best = np.arange(len(x))
    size = 1
    while size < w:
        step = min(size, w - size)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(x[b] < x[a], b, a)
        size += step
    return best[:n]


def runs_of(words: list[bytes], width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, first window, last window, anchor) of each run of windows with one anchor place."""
    h = hash_words(words)
    if len(h) < width:
        none = np.empty(0, np.int64)
        return h, none, none, none
    g = grams(h, gram)
    at = sliding_argmin(g, width - gram + 1)
    cut = np.flatnonzero(at[1:] != at[:-1]) + 1
    first = np.concatenate(([0], cut))
    last = np.concatenate((cut, [len(at)])) - 1
    return h, first, last, g[at[first]].view(np.int64)


# ---------------------------------------------------------------- FM-index


class BitVector:
    """Packed bits with a running count for each word of 64: one and a half bits a bit."""

    def __init__(self, bit: np.ndarray) -> None:
        packed = np.zeros((len(bit) // 64 + 1) * 8, np.uint8)
        packed[: -(-len(bit) // 8)] = np.packbits(bit.astype(bool), bitorder="little")
        self.words = packed.view("<u8")
        self.count = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.count[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """How many ones stand before place i."""
        w = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.count[w] + np.bitwise_count(self.words[w] & below)


class WaveletMatrix:
    """rank(c, i) over a sequence of numbers below 2^bits: a bit vector for each bit, high bits first."""

    def __init__(self, seq: np.ndarray, bits: int) -> None:
        self.bits, self.levels, self.zeros = bits, [], []
        x = seq
        for b in range(bits - 1, -1, -1):
            bit = (x >> b) & 1
            self.levels.append(BitVector(bit))
            self.zeros.append(len(x) - int(bit.sum()))
            x = np.concatenate((x[bit == 0], x[bit == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands before place i, less the start of c's own stretch (the same for every i)."""
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            one = self.levels[level].rank(i)
            i = np.where((c >> b) & 1, one + np.int32(self.zeros[level]), i - one)
        return i


class FMIndex:
    """Backward search over segments, each ended by a separator of its own that nothing matches."""

    def __init__(self, segments: list[np.ndarray], weight: np.ndarray) -> None:
        lengths = np.array([len(s) for s in segments])
        kinds, ids = np.unique(np.concatenate(segments), return_inverse=True)
        n_sep = len(segments)
        # Number 0 is the separator: rows that start with it are never asked for.
        self.start = np.concatenate(([0], np.cumsum(lengths + 1)))
        text = np.zeros(self.start[-1], np.int64)
        inside = np.ones(len(text), bool)
        inside[self.start[1:] - 1] = False
        text[inside] = ids + 1
        self.text = text.astype(np.int32)
        rank = text.copy()
        rank[~inside] = np.arange(n_sep)  # separators differ and come first
        rank[inside] += n_sep
        size, top = 1, int(rank.max()) + 1
        # Suffix ranks by doubling; a segment's end separates, so rounds follow the longest segment.
        while True:
            nxt = np.zeros(len(rank), np.int64)
            nxt[: max(0, len(rank) - size)] = rank[size:] + 1
            key = rank * (top + 1) + nxt
            kinds_of, rank = np.unique(key, return_inverse=True)
            top = len(kinds_of)
            if top == len(rank) or size > int(lengths.max()):
                break
            size *= 2
        sa = np.argsort(rank, kind="stable")
        bwt = text[sa - 1]
        self.bits = max(1, int(len(kinds)).bit_length())
        self.wavelet = WaveletMatrix(bwt, self.bits)
        counts = np.bincount(text, minlength=len(kinds) + 2)
        self.before = np.concatenate(([0], np.cumsum(counts)))[: len(kinds) + 2].astype(np.int32)
        self.origin = self.wavelet.rank(np.arange(len(kinds) + 1, dtype=np.int32), np.zeros(len(kinds) + 1, np.int32))
        owner = np.repeat(np.arange(n_sep), lengths + 1)
        self.weight = np.concatenate(([0], np.cumsum(weight[owner[sa]])))

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(c)
        both = self.wavelet.rank(np.concatenate((c, c)), np.concatenate((lo, hi)))
        base = self.before[c] - self.origin[c]
        return base + both[:n], base + both[n:]

    def match_back(self, end: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """For text places end: the smallest place s >= stop so that text[s..end] occurs at least twice; end + 1 if none does."""
        at = end + 1
        last = self.text[end]
        lo, hi = self.before[last], self.before[last + 1]  # the rows that start with the last word
        good = self.weight[hi] - self.weight[lo] >= 2
        at[good] = end[good]
        alive = np.flatnonzero(good & (end > stop))
        while len(alive):
            p = at[alive] - 1
            a, b = self.extend(self.text[p], lo[alive], hi[alive])
            good = self.weight[b] - self.weight[a] >= 2
            alive, p = alive[good], p[good]
            at[alive], lo[alive], hi[alive] = p, a[good], b[good]
            alive = alive[p > stop[alive]]
        return at


def repeated_windows(segments: list[np.ndarray], weight: np.ndarray, width: int) -> list[np.ndarray]:
    """For each segment a mask over its windows: those that occur at least twice in the shard."""
    fm = FMIndex(segments, weight)
    n = np.array([len(s) for s in segments])
    windows = n - width + 1
    base = fm.start[:-1]
    masks = [np.zeros(k, bool) for k in windows]
    # The longest repeated suffix: every window inside it is repeated.
    suffix = fm.match_back(base + n - 1, base) - base
    for i in np.flatnonzero(suffix < windows):
        masks[i][suffix[i] :] = True
    # What stands before the word that ended it, in one search likewise.
    live = np.flatnonzero((suffix > 0) & (suffix - 1 >= width))
    got = fm.match_back(base[live] + suffix[live] - 2, base[live]) - base[live]
    for i, g, end in zip(live, got, suffix[live] - 1):
        masks[i][g : max(g, end - width + 1)] = True
    # Then the windows left, from the left: a word where a window's match ends rules out every window across it.
    s = np.array([_first_open(m, 0) for m in masks])
    live = np.flatnonzero(s < windows)
    while len(live):
        first = base[live] + s[live]
        got = fm.match_back(first + width - 1, first)
        hit = got == first
        for i in live[hit]:
            masks[i][s[i]] = True
        after = np.where(hit, s[live] + 1, got - base[live])
        s[live] = [_first_open(masks[i], int(a)) for i, a in zip(live, after)]
        live = live[s[live] < windows[live]]
    return masks


def _first_open(mask: np.ndarray, at: int) -> int:
    """The first unset place from `at` on, or the mask's length."""
    while at < len(mask) and mask[at]:
        at += 1
    return at


# ---------------------------------------------------------------- the operator


def repeated_spans(docs: DataFrame, *, width: int = WIDTH, gram: int = GRAM, bound: int = 2000, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(tkey, starts): the first words of the repeated windows of each distinct text that has any."""

    def each(text):
        if text:
            yield hash64(text.encode()), len(words_of(text))

    texts = map_rows(docs.select("text"), each, "tkey long, n long").where(F.col("n") >= width).groupBy("tkey").agg(F.count("*").alias("copies"), F.first("n").alias("n"))
    texts = materialize(texts, "texts")

    place = arrow_schema("key long, tkey long, run int")

    def anchors(it):
        for b in pieces(it):
            out = []
            for text in b.column(0).to_pylist():
                if text:
                    _, first, _, anchor = runs_of(words_of(text), width, gram)
                    if len(first):
                        out.append((anchor, np.full(len(first), hash64(text.encode())), np.arange(len(first), dtype=np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], schema=place)

    runs = materialize(docs.select("text").mapInArrow(anchors, "key long, tkey long, run int"), "runs")
    # Written before it is joined, so that AQE can split the runs of a hot anchor.
    counts = materialize(runs.groupBy("key").agg(F.count("*").alias("places")).where("places > 1"), "places")
    shared = materialize(runs.join(counts, "key").groupBy("tkey", "run").agg(F.first("places").alias("places")), "anchors")
    release(runs, counts)

    # Windows of anchors with very many places: keyed by the whole window, and again those at one place only go.
    wanted = shared.groupBy("tkey").agg(F.collect_list(F.struct("run", (F.col("places") > bound).alias("hot"))).alias("runs"))
    wanted = materialize(wanted, "wanted")
    release(shared)
    held = bit_filter(wanted, "tkey")

    def pick(text):
        if text and in_filter(np.frombuffer(held, np.int64), key := hash64(text.encode())):
            yield key, text

    picked = map_rows(docs.select("text"), pick, "tkey long, text string").dropDuplicates(["tkey"]).join(wanted, "tkey")
    picked = picked.join(texts.select("tkey", "copies"), "tkey")

    #: start: first window; n: number of windows; seg: the words' hashes
    ddl = "key long, hot boolean, tkey long, start int, n int, copies long, item long, seg binary"
    schema = arrow_schema(ddl)

    def cut(it):
        def rows():
            for b in pieces(it):
                cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("tkey", "text", "runs", "copies")]
                for tkey, text, runs_, copies in zip(*cols):
                    h, first, last, anchor = runs_of(words_of(text), width, gram)
                    whole = grams(h, width).view(np.int64) if any(r["hot"] for r in runs_) else None
                    for r in runs_:
                        i = r["run"]
                        a, z = int(first[i]), int(last[i])
                        if r["hot"]:
                            for s in range(a, z + 1):
                                yield int(whole[s]), True, tkey, s, 1, copies, int(whole[s]), None
                        else:
                            seg = h[a : z + width].tobytes()
                            yield int(anchor[i]), False, tkey, a, z - a + 1, copies, hash64(seg), seg

        yield from batches_of(rows(), schema)

    cuts = materialize(picked.select("tkey", "text", "runs", "copies").mapInArrow(cut, ddl), "segments")
    # Hot windows carry no words yet: those at two places or more get them from one of their places.
    twice = cuts.where("hot").groupBy("item").agg(F.sum("copies").alias("weight"), F.min(F.struct("tkey", "start")).alias("at")).where("weight > 1")
    twice = materialize(twice, "twice")
    cold = cuts.where("not hot").groupBy("item", "seg").agg(F.min("key").alias("key"), F.sum("copies").alias("weight")).select("item", "key", "weight", "seg")
    source = twice.select("item", "weight", F.col("at.tkey").alias("tkey"), F.col("at.start").alias("start"))
    fetched = source.groupBy("tkey").agg(F.collect_list(F.struct("item", "weight", "start")).alias("asked")).join(picked.select("tkey", "text"), "tkey")

    def fetch(tkey, asked, text):
        h = hash_words(words_of(text))
        for x in asked:
            yield x["item"], x["item"], x["weight"], h[x["start"] : x["start"] + width].tobytes()

    segs = cold.unionByName(map_rows(fetched.select("tkey", "asked", "text"), fetch, "item long, key long, weight long, seg binary"))
    segs = materialize(segs, "distinct")
    total = segs.agg(F.sum(F.length("seg")).alias("b")).first()["b"] or 0
    shards = max(1, -(-int(total) // (8 * shard_words)))

    def search(_key, t):
        items, weight = t.column("item").to_pylist(), t.column("weight").to_numpy().astype(np.int64)
        segments = [np.frombuffer(s, np.uint64) for s in t.column("seg").to_pylist()]
        for item, mask in zip(items, repeated_windows(segments, weight, width)):
            if mask.any():
                yield item, np.flatnonzero(mask).astype(np.int32).tolist()

    found = by_groups(segs.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("key"), "item", "weight", "seg"), search, "item long, offsets array<int>")
    back = cuts.select("item", "tkey", "start").join(found, "item").select("tkey", F.transform("offsets", lambda o: o + F.col("start")).alias("starts"))
    near = back.groupBy("tkey").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    return near


def remove_repeats(docs: DataFrame, *, width: int = WIDTH, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every row with the words that stay."""
    with few_rows_a_batch(docs.sparkSession):
        spans = materialize(repeated_spans(docs, width=width, **options), "spans")
    held = bit_filter(spans, "tkey")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def clean(doc_id, text):
        words = words_of(text)
        if not (text and in_filter(np.frombuffer(held, np.int64), hash64(text.encode()))):
            yield doc_id, len(words), 0, b" ".join(words).decode()

    def maybe(doc_id, text):
        if text and in_filter(np.frombuffer(held, np.int64), key := hash64(text.encode())):
            yield doc_id, key, text

    def cut(doc_id, text, starts):
        words = words_of(text)
        cover = np.zeros(len(words) + 1, np.int64)
        at = np.array(starts or (), np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + width, -1)
        gone = np.cumsum(cover[:-1]) > 0
        yield doc_id, len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone) if not g).decode()

    ddl = "doc_id long, n_words long, n_removed long, kept string"
    touched = map_rows(source, maybe, "doc_id long, tkey long, text string").join(spans, "tkey", "left").select("doc_id", "text", "starts")
    return map_rows(source, clean, ddl).unionByName(map_rows(touched, cut, ddl))


def kept_digests(docs: DataFrame, **options) -> DataFrame:
    """The digest columns of the query from the operator's texts; hashed by Spark, without another Python worker a task."""
    with few_rows_a_batch(docs.sparkSession):
        return materialize(remove_repeats(docs, **options).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")), "digests")
