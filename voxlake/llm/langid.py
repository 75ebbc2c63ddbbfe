"""Language identification by nearest centroid.

A text becomes counts of letter n-grams (1 to 3 code points of the case-folded
text, each run of non-letters read as one blank) hashed to 2^14 coordinates,
weighted (1 + log tf) * idf and normalised. idf is counted over every training
document. Each language keeps several centroids, found by spherical k-means on
at most `fit_docs` of its training documents (expected number; a row's hash
decides, so the choice doesn't depend on partitions). A text gets the language
of the centroid with the largest cosine; when 1 - cosine exceeds the language's
radius (the `reject_quantile` of its fitted documents, widened by `slack`) the
prediction is marked rejected.

Defined results: null texts and texts without a letter are `und`, score 0,
rejected; rows whose language is null, or whose fold is unknown because doc_id
is null, aren't learned from; with nothing to learn from every text is `und`;
equal cosines go to the first centroid, languages in order of their names; repeated rows
get equal predictions and copies of a text are one text of the fit; columns of docs named
lang_pred, score or rejected are replaced. Texts of any length are counted whole, in slices.
More than `max_langs` languages are refused: each has centroids in the broadcast model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_groups, mix, pieces

BITS = 14
DIM = 1 << BITS
SLICE = 1 << 18


def letters_of(low: str) -> np.ndarray:
    """Code points of case-folded text, 0 for what isn't a letter."""
    x = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (x >= 97) & (x <= 122)
    high = np.flatnonzero(x > 127)
    if len(high):
        kinds, at = np.unique(x[high], return_inverse=True)
        letter[high] = np.array([chr(k).isalpha() for k in kinds])[at]
    return np.where(letter, x, 0).astype(np.uint32)


def counts_of(text: str | None) -> np.ndarray | None:
    """n-gram counts of a whole text, or None without a letter. Every run of non-letters is one blank, also at both ends.

    Long texts are counted slice by slice, the last two code points going on to the next, which gives the counts of the whole.
    """
    if not text:
        return None
    low = text.lower()
    out = np.zeros(DIM, np.float64)
    some, tail = False, np.empty(0, np.uint64)
    for s in range(0, len(low) + 1, SLICE):
        x = letters_of(low[s : s + SLICE])
        some = some or bool(x.any())
        ends = [np.zeros(1, np.uint32)] * (s + SLICE > len(low))
        x = np.concatenate((np.zeros(int(s == 0), np.uint32), x, *ends))
        before = np.concatenate((tail[-1:].astype(np.uint32) if len(tail) else np.ones(1, np.uint32), x[:-1])) if len(x) else x
        x = x[(x != 0) | (before != 0)].astype(np.uint64)
        whole = np.concatenate((tail, x))
        h = whole + np.uint64(1)
        for n in range(3):
            if n:
                h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + whole[n:] + np.uint64(1)
            new = h[max(0, len(h) - len(x)) :] if len(x) else h[:0]  # those that end in this slice
            out += np.bincount((mix(new) >> np.uint64(64 - BITS)).astype(np.int64), minlength=DIM)
        tail = whole[-2:]
    return out.astype(np.float32) if some else None


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return (v / np.maximum(n, 1e-12)).astype(np.float32)


def document_frequency(train: DataFrame) -> tuple[np.ndarray, int]:
    """In how many training texts each coordinate occurs. Every task sends DIM numbers at most to a sum by coordinate."""

    def partial(it):
        df, n = np.zeros(DIM + 1, np.int64), 0
        for b in pieces(it):
            for t in b.column(0).to_pylist():
                c = counts_of(t)
                if c is not None:
                    df[:DIM] += c > 0
                    n += 1
        df[DIM] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["at", "n"])

    out = np.zeros(DIM + 1)
    for at, n in train.select("text").mapInArrow(partial, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        out[at] = n
    return out[:DIM], int(out[DIM])


def cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the vector nearest the mean, then the ones farthest from those chosen."""
    mean = v.mean(0)
    first = int(np.argmax(v @ mean))
    chosen, near = [first], v @ v[first]
    while len(chosen) < min(k, len(v)):
        far = int(np.argmin(near))
        if near[far] > 1 - 1e-6:
            break
        chosen.append(far)
        near = np.maximum(near, v @ v[far])
    c = v[chosen].copy()
    for _ in range(rounds):
        own = np.argmax(v @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = v[own == j].mean(0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def fit(train: DataFrame, *, text: str = "text", lang: str = "lang", fit_docs: int = 600, per_lang: int = 4, reject_quantile: float = 0.999, slack: float = 0.05, max_langs: int = 500) -> dict | None:
    """The model: idf, centroids, their languages and radii. train holds (text, lang), lang not null."""
    train = train.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    found = train.groupBy("lang").agg(F.count("*").alias("n")).limit(max_langs + 1).collect()  # one row a language
    if len(found) > max_langs:
        raise ValueError(f"more than {max_langs} languages; give a coarser column or raise max_langs")
    sizes = {r[0]: r[1] for r in found}
    if not sizes:
        return None
    idf_df, n = document_frequency(train)
    if not n:
        return None
    idf = (np.log((1 + n) / (1 + idf_df)) + 1).astype(np.float32)
    names = sorted(sizes)
    rate = F.create_map(*[x for k in names for x in (F.lit(k), F.lit(min(1.0, fit_docs / sizes[k])))])
    ordinal = F.create_map(*[x for i, k in enumerate(names) for x in (F.lit(k), F.lit(i))])
    u = F.pmod(F.xxhash64("text", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    # A text's hash decides, so all copies of a chosen text come along: one of them is learned from.
    some = train.where(u < F.element_at(rate, F.col("lang"))).dropDuplicates(["lang", "text"]).select(F.element_at(ordinal, F.col("lang")).cast("long").alias("key"), "text")

    def learn(key, t):
        v = [c for c in map(counts_of, t.column("text").to_pylist()) if c is not None]
        if not v:
            return
        v = weighted(np.array(v), idf)
        # An order of its own, so that the fit doesn't depend on how rows arrive.
        v = v[np.lexsort(np.round(v[:, :: DIM // 8], 6).T)]
        c = cluster(v, per_lang)
        far = float(np.quantile(1 - (v @ c.T).max(1), reject_quantile)) + slack
        for row in c:
            yield int(key), row.astype(np.float32).tobytes(), far

    got = by_groups(some, learn, "lang long, centroid binary, radius double").collect()  # per_lang rows a language
    got = sorted(((int(k), bytes(c), r) for k, c, r in got))
    if not got:
        return None
    return {"idf": idf, "langs": [names[k] for k, _, _ in got], "centroids": np.array([np.frombuffer(c, np.float32) for _, c, _ in got]), "radius": np.array([r for _, _, r in got])}


def predict(docs: DataFrame, model: dict | None, *, text: str = "text") -> DataFrame:
    """docs plus lang_pred, score, rejected. The model is broadcast: DIM numbers a centroid."""
    from pyspark.sql import types as T

    docs = docs.drop("lang_pred", "score", "rejected")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(it):
        m = held.value
        for b in pieces(it):
            pred, score, far = [], [], []
            for t in b.column(b.schema.get_field_index(text)).to_pylist():
                c = counts_of(t) if m else None
                if c is None:
                    pred.append("und"), score.append(0.0), far.append(True)
                    continue
                sim = m["centroids"] @ weighted(c, m["idf"])
                i = int(np.argmax(sim))
                pred.append(m["langs"][i]), score.append(float(min(1.0, max(0.0, sim[i])))), far.append(bool(1 - sim[i] > m["radius"][i]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())], names=[*b.schema.names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, schema)


def identify_languages(docs: DataFrame, **options) -> DataFrame:
    """Learn from the folds other than 2 of crc32(doc_id), predict for every document."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = fit(docs.where((fold != 2) & F.col("lang").isNotNull()).select("text", "lang"), **options)
    rows = docs.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "text")
    return predict(rows, model).drop("text")

