"""Alignment of two tokenizers' tokens over the bytes of each text.

Python only tokenises. It cuts texts at spaces between two characters that aren't white space, where no token of either
tokenizer goes across, and encodes each distinct segment of a batch of documents once: a row holds the batch's segments, with
the ids and byte ends of their tokens under A and B, and its documents as lists of segments. All else is Spark's array
functions. The offsets where tokens of both end, array_intersect of the end arrays, cut a segment into groups;
sequence and transform slice both sides by group. Inside a group an A and a B token that overlap are a link: where one
side has one token it is linked with each of the other, else the sorted ends of both sides say which tokens stand at each
cut (n + m - 1 links for n and m tokens). A document's groups and links are those of its segments in order; aggregates count them.

Links are counted over the corpus by pairs of ids, once a document; a row carries each of its distinct pairs with
the number of its links, so one pair has at most a row for each document, and the counts are combined before their
shuffle. Counts are joined back by pair, and sums by row.

Defined results: a text that is null or empty, or whose tokens' bytes under A or B differ from a space and the text (a
text with U+2581, say), has no tokens: zeros and an empty string. Special tokens' strings are plain text.
Repeated rows are each a document and are counted each; a null doc_id stays null; long texts are taken whole;
extra columns are ignored; an empty table gives no rows. A table whose ids don't fit an integer together is refused, and so is
a piece model whose pieces hold a space after another character.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, pieces, release
from .vocab import BYTE_BPE, PIECE_BPE, ByteLevel, default_path, file_bytes, piece_encoder, shipped, sized

INTS = T.ArrayType(T.IntegerType(), False)
SEGMENT = T.StructType([T.StructField(c, INTS, False) for c in ("a_ids", "a_ends", "b_ids", "b_ends")])
DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_a", T.LongType(), False), T.StructField("n_b", T.LongType(), False), T.StructField("segments", INTS, False)])
BATCH = T.StructType([T.StructField("segments", T.ArrayType(SEGMENT, False), False), T.StructField("docs", T.ArrayType(DOCUMENT, False), False)])
#: Characters of the texts whose segments are encoded together, but for one longer document.
TOGETHER = 1 << 21
#: A cut: a space between characters that aren't white space.
CUT = re.compile(r"(?<=\S) (?=\S)")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, though a lambda inside reads it for each element."""
    return F.transform(F.array(value), body)[0]


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All values, and where each list starts and the last ends."""
    starts = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    return np.fromiter(chain.from_iterable(lists), np.int32, int(starts[-1])), starts


def list_array(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(values.astype(np.int32)))


class Encoders:
    """Both tokenizers over distinct segments."""

    def __init__(self, byte_level: bytes, piece_model: bytes) -> None:
        a = ByteLevel(byte_level, plain=True)
        encode_b, b_bytes = piece_encoder(piece_model)
        self.sides = [(lambda segments: [a.encode(" " + s) for s in segments], a.bytes, sized(a.bytes)), (encode_b, b_bytes, sized(b_bytes))]

    def encoded(self, segments: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
        """For each side ids, byte ends inside the segments and starts; and which segments have other bytes than a space and their text, and so no tokens."""
        bad = np.zeros(len(segments), bool)
        whole = [(" " + s).encode() for s in segments]
        both = [encode(segments) for encode, _, _ in self.sides]
        for lists, (_, table, _) in zip(both, self.sides):
            if b"".join([table[i] for i in chain.from_iterable(lists)]) != b"".join(whole):  # look for those that differ
                bad |= np.fromiter((b"".join([table[i] for i in ids]) != w for ids, w in zip(lists, whole)), bool, len(segments))
        out = []
        for lists, (_, _, lengths) in zip(both, self.sides):
            ids, starts = flat([[] if b else ids for b, ids in zip(bad, lists)] if bad.any() else lists)
            ends = np.concatenate([[0], np.cumsum(lengths[ids])])
            out.append((ids, ends[1:] - np.repeat(ends[starts[:-1]], np.diff(starts)), starts))
        return out, bad


def tokenise(docs: DataFrame, byte_level: str, piece_model: str, together: int = TOGETHER) -> DataFrame:
    """(segments, docs): batches of documents with their distinct segments."""
    files = shipped(docs.sparkSession, byte_level, piece_model)
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(BATCH)

    def batch(encoders: Encoders, number: dict[str, int], held: list[tuple]) -> pa.RecordBatch:
        sides, bad = encoders.encoded(list(number))
        lists = [a for ids, ends, starts in sides for a in (list_array(ids, starts), list_array(ends, starts))]
        places = [p if not bad[p].any() else p[:0] for _, p in held]
        counts = [np.diff(starts) for _, _, starts in sides]
        columns = [pa.array([d for d, _ in held], pa.int64()), *(pa.array([int(n[p].sum()) for p in places], pa.int64()) for n in counts)]
        starts = np.cumsum([0, *map(len, places)]).astype(np.int32)
        columns.append(list_array(np.concatenate([np.empty(0, np.int32), *places]), starts))
        both = pa.StructArray.from_arrays(lists, names=SEGMENT.names), pa.StructArray.from_arrays(columns, names=DOCUMENT.names)
        whole = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v).cast(f.type) for v, f in zip(both, schema)]
        return pa.RecordBatch.from_arrays(whole, schema=schema)

    def run(it):
        encoders, number, held, size = Encoders(*files.value), {}, [], 0
        for part in pieces(it):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found = [number.setdefault(s, len(number)) for s in CUT.split(text)] if text else []
                held.append((doc_id, np.array(found, np.int32)))
                size += len(text or "")
                if size >= together:
                    yield batch(encoders, number, held)
                    number, held, size = {}, [], 0
        if held:
            yield batch(encoders, number, held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BATCH)


def cut_places(merged: Column) -> Column:
    """0, and how many tokens stand up to each cut, from the sorted ends of tokens and cuts: an end that is a cut stands there twice."""
    return let(merged, lambda m: F.concat(F.array(F.lit(0)), F.transform(F.filter(F.sequence(F.lit(1), F.size(m) - 1), lambda p: m[p] == m[p - 1]), lambda p, k: p - k)))


def part(values: Column, places: Column, k: Column) -> Column:
    """The k-th group's part of an array. (slice() copies the whole array each time, when a lambda calls it.)"""
    return F.transform(F.sequence(places[k], places[k + 1] - 1), lambda i: values[i])


def staircase(a: Column, b: Column, a_ends: Column, b_ends: Column, width: int) -> Column:
    """The links of a group with several tokens on both sides, one for each end of either.

    Ends are sorted with their side and number. At the p-th of them, the i-th of its own side, p - i ends of the other side
    stand before it, so that side's token of that number is the one there. The last end is both sides' and counts once.
    """
    code = lambda ends, side: F.transform(ends, lambda e, i: F.shiftleft(e.cast("long"), 32) + side + i)
    side_b = 1 << 31
    ends = F.concat(code(a_ends, 0), code(F.slice(b_ends, 1, F.size(b_ends) - 1), side_b))

    def link(x: Column, p: Column) -> Column:
        i = x.bitwiseAND(F.lit(side_b - 1)).cast("int")
        return F.when(x.bitwiseAND(F.lit(side_b)) == 0, a[i] * width + b[p - i]).otherwise(a[p - i] * width + b[i])

    return F.transform(F.sort_array(ends), link)


def group_links(a: Column, b: Column, a_ends: Column, b_ends: Column, width: int) -> Column:
    """The pairs (A id * width + B id) of a group's links."""
    one_a = F.transform(b, lambda y: a[0] * width + y)
    one_b = F.transform(a, lambda x: x * width + b[0])
    return F.when(F.size(a) == 1, one_a).when(F.size(b) == 1, one_b).otherwise(staircase(a, b, a_ends, b_ends, width))


def align_segment(s: Column, width: int) -> Column:
    """struct(text, links, groups): a segment's groups as written for the digest, the pairs of its links, the number of its groups."""
    a, a_ends, b, b_ends = (s.getField(c) for c in SEGMENT.names)

    def groups_of(cuts: Column, at_a: Column, at_b: Column) -> Column:
        def text(k: Column) -> Column:
            def written(ids: Column, at: Column) -> Column:
                return F.when(at[k] + 1 == at[k + 1], ids[at[k]].cast("string")).otherwise(F.array_join(part(ids, at, k).cast("array<string>"), ","))

            return F.concat(written(a, at_a), F.lit("|"), written(b, at_b))

        def links(k: Column) -> Column:
            one = F.array(a[at_a[k]] * width + b[at_b[k]])
            more = let(part(a, at_a, k), lambda x: let(part(b, at_b, k), lambda y: group_links(x, y, part(a_ends, at_a, k), part(b_ends, at_b, k), width)))
            return F.when(at_a[k + 1] - at_a[k] + at_b[k + 1] - at_b[k] == 2, one).otherwise(more)

        each = lambda body: F.transform(F.sequence(F.lit(0), F.size(cuts) - 1), body)
        return F.struct(F.array_join(each(text), ";").alias("text"), F.flatten(each(links)).alias("links"), F.size(cuts).alias("groups"))

    places = lambda cuts, ends: cut_places(F.sort_array(F.concat(ends, cuts)))
    many = let(F.array_intersect(a_ends, b_ends), lambda cuts: let(places(cuts, a_ends), lambda at_a: let(places(cuts, b_ends), lambda at_b: groups_of(cuts, at_a, at_b))))
    single = F.struct(F.concat(a[0].cast("string"), F.lit("|"), b[0].cast("string")).alias("text"), F.array(a[0] * width + b[0]).alias("links"), F.lit(1).alias("groups"))
    none = F.struct(F.lit("").alias("text"), F.expr("cast(array() as array<int>)").alias("links"), F.lit(0).alias("groups"))
    return F.when(F.size(a) == 0, none).when((F.size(a) == 1) & (F.size(b) == 1), single).otherwise(many)


def align_rows(batches: DataFrame, width: int) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): times has the links of each distinct pair."""

    def document(d: Column, held: Column) -> Column:
        places = d.getField("segments")
        texts = F.array_join(F.transform(places, lambda i: held[i].getField("text")), ";")
        links = F.flatten(F.transform(places, lambda i: held[i].getField("links")))
        groups = F.aggregate(places, F.lit(0).cast("long"), lambda n, i: n + held[i].getField("groups"))
        return F.struct(*(d.getField(c).alias(c) for c in ("doc_id", "n_a", "n_b")), groups.alias("n_groups"), F.when(F.size(places) == 0, "").otherwise(F.sha2(texts, 256)).alias("groups_sha256"), links.alias("links"))

    aligned = F.transform("segments", lambda s: align_segment(s, width))
    rows = batches.select(F.explode(let(aligned, lambda held: F.transform("docs", lambda d: document(d, held)))).alias("d")).select("d.*")
    # A row's number isn't deterministic, so Spark keeps this projection apart: what lambdas read is computed once.
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", F.sort_array("links").alias("links"))
    # Where a pair's run ends: before each change, and at the end.
    ends = lambda s: F.concat(F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda i: s[i] != s[i - 1]), F.array(F.size(s)))
    times = let(F.col("links"), lambda s: let(F.when(F.size(s) < 2, F.array(F.size(s))).otherwise(ends(s)), lambda e: F.transform(e, lambda x, k: F.when(k == 0, x).otherwise(x - e[F.greatest(k - 1, F.lit(0))]))))
    none = F.expr("cast(array() as array<int>)")
    counted = rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", F.array_distinct("links").alias("pairs"), F.when(F.size("links") == 0, none).otherwise(times).alias("times"))
    return counted.withColumn("n_links", F.aggregate("times", F.lit(0).cast("long"), lambda n, t: n + t))


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): documents that hold a pair linked, and whether no other pair of its A id has more."""
    counts = materialize(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    a = F.floor(F.col("pair") / width)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    out = materialize(counts.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")
    release(counts)
    return out


def align_tokenizers(docs: DataFrame, *, byte_level: str | None = None, piece_model: str | None = None) -> DataFrame:
    """One row per document: tokens of both sides, groups, links, and what the corpus says of its links."""
    byte_level, piece_model = byte_level or default_path(BYTE_BPE), piece_model or default_path(PIECE_BPE)
    held = piece_encoder(file_bytes(piece_model))[1]
    width = len(held)
    if any(b" " in p.lstrip(b" ") for p in held):
        raise ValueError("pieces of this model go across the cuts of segments")
    if (max(ByteLevel(file_bytes(byte_level), plain=True).bytes) + 1) * width > 1 << 31:
        raise ValueError("the ids of the two vocabularies don't fit an integer together")
    rows = materialize(align_rows(tokenise(docs, byte_level, piece_model), width), "aligned")
    links = rows.select("row", F.posexplode("pairs").alias("k", "pair"), "times").select("row", "pair", F.col("times")[F.col("k")].cast("long").alias("times"))
    joined = links.join(pair_counts(rows, width), "pair")
    sums = joined.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
