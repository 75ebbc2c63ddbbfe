"""Quality rules: cross-document line frequency per host.

Lines are normalised (case folded, white space collapsed) and hashed. For each
host the distinct documents that hold a line are counted; byte-identical texts
of a host are one document, so a group of exact copies isn't boilerplate. A line
in more than max(min_docs, share * documents of the host) documents, but in no case
in more than `most_docs`, is left: the limit doesn't rise without bound with the host. A document is rejected when fewer than `min_left` of its words remain.
cut_frequent_lines() returns the documents without those lines.

Defined results: a null text is empty; an empty text has no lines, so it is never
depleted (but the word rule fails it); a null host is one host of its own; a cut
line goes with its line break, lines without words stay, a null text stays null
and a text of nothing but frequent lines becomes empty; very long texts and lines are taken whole; a line at the
limit stays (ties don't arise);
repeated rows get equal verdicts; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, hash64, map_rows, materialize, pieces, release, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
STATS = (
    "doc_id long, host string, tkey long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "lines array<struct<h:long,w:int>>"
)


def repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of `width` words that occur twice or more in the text.

    Windows get exact numbers by doubling: numbers of two halves, then of pairs of numbers.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    size = 1
    while size < width:
        step = min(size, width - size)
        m = len(ids) - step
        pairs = ids[:m] * (int(ids.max()) + 1) + ids[step : step + m]
        ids = np.unique(pairs, return_inverse=True)[1]
        size += step
    again = np.bincount(ids)[ids] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def line_hash(own: list[bytes]) -> int:
    """The hash of a line's folded words."""
    return hash64(b" ".join(own).decode().lower().encode())


def text_stats(text: str | None) -> tuple:
    t = text or ""
    words = words_of(t)
    lines, seen, dup = {}, set(), 0
    for line in t.split("\n"):
        own = words_of(line)
        if own:
            dup += line in seen
            seen.add(line)
            h = line_hash(own)
            lines[h] = lines.get(h, 0) + len(own)
    return (
        len(words), len(t) - sum(map(t.count, SPACES)), sum(map(t.count, SYMBOLS)), dup, repeat_words(words), [{"h": h, "w": w} for h, w in lines.items()]
    )


def line_frequency_rules(
    docs: DataFrame, *, host: str = "source", min_docs: int = 10, share: float = 0.02, most_docs: int = 1000, min_left: float = 0.2, min_words: int = 20, max_repeat_pct: int = 30
) -> DataFrame:
    """One row per document: base counts, words left without frequent lines, verdict."""
    options = {"host": host, "min_docs": min_docs, "share": share, "most_docs": most_docs, "min_left": min_left, "min_words": min_words, "max_repeat_pct": max_repeat_pct}
    return judged(docs, **options)[0]


def judged(docs: DataFrame, *, host: str, min_docs: int, share: float, most_docs: int, min_left: float, min_words: int, max_repeat_pct: int) -> tuple[DataFrame, DataFrame]:
    """(verdicts, hits): line_frequency_rules' rows, and (host, tkey, h, w) of every frequent line of every text."""

    def each(doc_id, h, text):
        yield (doc_id, h, hash64((text or "").encode()), *text_stats(text))

    stats = materialize(map_rows(docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), "text"), each, STATS), "quality", texts=True)
    texts = stats.select("host", "tkey", "lines", "n_words")
    held = texts.select("host", "tkey", F.explode("lines").alias("l")).select("host", "tkey", F.col("l.h").alias("h"), F.col("l.w").alias("w")).groupBy("host", "tkey", "h").agg(F.first("w").alias("w"))
    held = materialize(held, "lines")
    per_host = materialize(texts.groupBy("host", "tkey").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("docs")), "hosts")
    counts = held.groupBy("host", "h").agg(F.count("*").alias("docs_with"))
    limit = F.least(F.greatest(F.lit(float(min_docs)), F.lit(share) * F.col("docs")), F.lit(float(max(min_docs, most_docs))))
    same_host = F.col("c.host").eqNullSafe(F.col("p.host"))
    frequent = counts.where(F.col("docs_with") > min_docs).alias("c").join(per_host.alias("p"), same_host).where(F.col("docs_with") > limit).select(F.col("c.host").alias("fhost"), F.col("c.h").alias("fh"))
    # Small sides are written before they are joined, so that AQE can split a hot key of the other side.
    frequent = materialize(frequent, "frequent")
    hits = materialize(held.join(frequent, F.col("host").eqNullSafe(F.col("fhost")) & (F.col("h") == F.col("fh"))).select("host", "tkey", "h", "w"), "frequent-lines")
    release(held, per_host, frequent)
    gone = hits.groupBy(F.col("host").alias("ghost"), F.col("tkey").alias("gkey")).agg(F.sum("w").alias("gone"), F.count("*").alias("n_frequent_lines"))
    out = stats.drop("lines").join(materialize(gone, "lost"), F.col("host").eqNullSafe(F.col("ghost")) & (F.col("tkey") == F.col("gkey")), "left")
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    failed = (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(max_repeat_pct) * F.col("n_words"))
    depleted = left < F.lit(min_left) * F.col("n_words")
    verdicts = out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
        left.alias("n_words_left"), F.coalesce("n_frequent_lines", F.lit(0).cast("long")).alias("n_frequent_lines"), "host", "tkey",
    )
    return verdicts, hits


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns."""
    verdict = line_frequency_rules(docs, **options)
    good = verdict.where("kept").select(F.col("host").alias("__h"), F.col("tkey").alias("__k"), F.col("n_words").alias("__n")).distinct()
    good = materialize(good, "good")
    host = options.get("host", "source")
    keyed = with_text_key(docs)
    return keyed.join(good, (F.col("__tkey") == F.col("__k")) & F.col(host).cast("string").eqNullSafe(F.col("__h")), "left_semi").drop("__tkey")


def cut_frequent_lines(
    docs: DataFrame, *, good_only: bool = False, host: str = "source", min_docs: int = 10, share: float = 0.02, most_docs: int = 1000, min_left: float = 0.2, min_words: int = 20, max_repeat_pct: int = 30
) -> DataFrame:
    """docs with the frequent lines of their host cut from `text`; good_only: without the rows that the rules reject.

    Lines are counted over all of docs, rejected rows too.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    verdicts, hits = judged(docs, host=host, min_docs=min_docs, share=share, most_docs=most_docs, min_left=min_left, min_words=min_words, max_repeat_pct=max_repeat_pct)
    cuts = hits.groupBy(F.col("host").alias("__h"), F.col("tkey").alias("__k")).agg(F.collect_set("h").alias("__cut"))
    how = "left"
    if good_only:
        good = verdicts.where("kept").select(F.col("host").alias("__gh"), F.col("tkey").alias("__gk")).distinct()
        cuts = good.join(cuts, (F.col("__gk") == F.col("__k")) & F.col("__gh").eqNullSafe(F.col("__h")), "left").select(F.col("__gh").alias("__h"), F.col("__gk").alias("__k"), "__cut")
        how = "inner"
    cuts = materialize(cuts, "cuts")
    names = docs.columns
    joined = with_text_key(docs).join(cuts, (F.col("__tkey") == F.col("__k")) & F.col(host).cast("string").eqNullSafe(F.col("__h")), how).select(*names, "__cut")

    def cut(it):
        for b in pieces(it):
            at = b.schema.get_field_index("text")
            new = []
            for t, gone in zip(b.column(at).to_pylist(), b.column(b.schema.get_field_index("__cut")).to_pylist()):
                if t and gone:
                    gone = set(gone)
                    t = "\n".join(x for x in t.split("\n") if not ((own := words_of(x)) and line_hash(own) in gone))
                new.append(t)
            cols = [pa.array(new, pa.string()) if n == "text" else b.column(b.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.mapInArrow(cut, T.StructType(docs.schema.fields))


def with_text_key(docs: DataFrame) -> DataFrame:
    """docs plus __tkey, the hash that the stages use for a text."""
    import pyarrow as pa

    def run(it):
        for b in pieces(it):
            keys = [hash64((t or "").encode()) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64())], names=[*b.schema.names, "__tkey"])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__tkey", T.LongType())]))
