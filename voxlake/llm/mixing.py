"""Mixing sources to target weights by temperature.

Weights are p_i ~ t_i^a with t_i the tokens of source i. The exponent a is
bisected to the flattest mix whose largest repetition (tokens drawn / tokens
held) stays within `max_repeat`, or to the mix of a given entropy (nats). The
budget is a number of tokens, or, by default, what makes the largest source run
exactly once; then every document occurs at least once. A target that no exponent
reaches is an error.

Each source is cut into blocks of about `block_docs` documents; whole epochs take
every document, and the rest of a source's budget takes blocks in a permuted
order and, within the block where it ends, documents in a permuted order while they
fit. Which documents those are is said by one row a source (the place of the last
block and of the last document in it), so no text is shuffled to decide it, and a third of
all rows in one source is spread over its blocks. realise() then writes the
blocks of all epochs in permuted order.

Defined results: a null source is one source; a source without tokens has no
weight and its rows are kept once; null and empty texts count no tokens; texts of any
length are counted whole; rows equal in id, source and text are taken together or not
at all; an empty table stays empty; columns of docs named n_tokens, weight or copies
are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release

WORD = r"[^ \t\n\x0B\f\r]+"


def word_count(col: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def hashed(*parts: str | Column) -> Column:
    """60 bits of an MD5, which other engines have too; a null part is empty."""
    text = F.concat_ws(":", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def shares(tokens: list[int], exponent: float) -> list[float]:
    top = max(tokens)
    w = [math.exp(exponent * math.log(t / top)) for t in tokens]
    return [x / sum(w) for x in w]


def entropy(p: list[float]) -> float:
    return -sum(x * math.log(x) for x in p if x > 0)


def bisect(measure: Callable[[float], tuple[float, float]], *, max_repeat: float | None, target_entropy: float | None, rounds: int = 80) -> float:
    """The exponent at which the target is met; measure(a) is (entropy, largest repetition), both of which fall as a grows.

    A repetition limit is met by the smallest exponent in [0, 1] that keeps it; an entropy may need an exponent above 1.
    """
    if target_entropy is None and max_repeat is None:
        return 1.0
    fits = lambda a: measure(a)[0] <= target_entropy if target_entropy is not None else measure(a)[1] <= max_repeat
    low, high = 0.0, 1.0
    if target_entropy is not None:
        if not 0 <= target_entropy <= measure(0.0)[0] * (1 + 1e-12):
            raise ValueError(f"the entropy of a mix of these sources lies between 0 and {measure(0.0)[0]:.6g}, not at {target_entropy}")
        while not fits(high):
            high *= 2
            if high > 1 << 20:
                raise ValueError(f"no exponent gives an entropy of {target_entropy}: sources of equal size stay equal")
    elif fits(0.0):
        return 0.0
    elif not fits(1.0 + 1e-12):
        raise ValueError(f"the budget repeats every mix of these sources more than {max_repeat} times; {measure(1.0)[1]:.6g} is the least")
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def whole(draw: float) -> int:
    """Tokens to draw, as a whole number."""
    return int(draw * (1 + 1e-12) + 1e-6)


def plan(tokens: dict[str | None, int], *, budget: float | None = None, max_repeat: float | None = 1.5, target_entropy: float | None = None) -> dict:
    """exponent, and for each source with tokens its weight and whole number of tokens to draw."""
    names = sorted((k for k, t in tokens.items() if t > 0), key=lambda k: (k is None, k or ""))
    if not names:
        return {"exponent": 1.0, "sources": {}}
    held = [tokens[k] for k in names]

    def drawn(a: float) -> tuple[list[float], list[float]]:
        p = shares(held, a)
        total = budget if budget is not None else max(held) / max(p)
        return p, [total * x for x in p]

    def measure(a: float) -> tuple[float, float]:
        p, draw = drawn(a)
        return entropy(p), max(d / t for d, t in zip(draw, held, strict=True))

    a = bisect(measure, max_repeat=max_repeat, target_entropy=target_entropy)
    p, draw = drawn(a)
    return {"exponent": a, "sources": {k: {"weight": w, "draw": whole(d)} for k, w, d in zip(names, p, draw, strict=True)}}


def planned(totals: DataFrame, *, budget: float | None = None, max_repeat: float | None = 1.5, target_entropy: float | None = None) -> DataFrame:
    """plan() for any number of sources: (__s, t, n) plus weight and draw, by one small aggregate for each exponent tried."""
    some = totals.where("t > 0")
    if not (top := some.agg(F.max("t")).first()[0]):
        return totals.withColumns({"weight": F.lit(0.0), "draw": F.lit(None).cast("long")})
    w = lambda a: F.exp(a * F.log(F.col("t") / float(top)))
    total = lambda z: budget if budget is not None else top * z

    def measure(a: float) -> tuple[float, float]:
        x = w(a)
        z, e, r = some.agg(F.sum(x), F.sum(x * a * F.log(F.col("t") / float(top))), F.max(x / F.col("t"))).first()
        return math.log(z) - e / z, r * total(z) / z

    a = bisect(measure, max_repeat=max_repeat, target_entropy=target_entropy)
    z = some.agg(F.sum(w(a))).first()[0]
    share = F.when(F.col("t") > 0, w(a) / z)
    return totals.withColumns({"weight": F.coalesce(share, F.lit(0.0)), "draw": F.floor(share * total(z) * (1 + 1e-12) + 1e-6)})


def mix_sources(docs: DataFrame, *, source: str = "source", key: str = "doc_id", tokens: Column | None = None, block_docs: int = 4096, seed: int = 7, max_sources: int = 100_000, **target) -> DataFrame:
    """docs plus n_tokens, weight and copies (how often the mix takes the row; 0: not at all).

    Up to `max_sources` sources are planned on the driver and their rows are broadcast; more are planned by aggregates and joined.
    """
    names = [*[c for c in docs.columns if c not in ("n_tokens", "weight", "copies")], "n_tokens", "weight", "copies"]
    marked = _with_places(docs, source, key, tokens, seed)
    # One small row a document: everything is decided from these.
    slim = materialize(marked.groupBy("__src", "__rank", "n_tokens").agg(F.count("*").alias("c")), "ranks")
    totals = slim.groupBy(F.col("__src").alias("__s")).agg(F.sum(F.col("n_tokens") * F.col("c")).alias("t"), F.sum("c").alias("n"))
    few = totals.limit(max_sources + 1).collect()
    many = len(few) > max_sources
    if many:
        made = planned(materialize(totals, "sources"), **target)
    else:
        own = plan({r["__s"]: int(r["t"]) for r in few}, **target)["sources"]
        none = {"weight": 0.0, "draw": None}
        rows = [(r["__s"], int(r["t"]), int(r["n"]), *(own.get(r["__s"], none)[k] for k in ("weight", "draw"))) for r in few]
        made = docs.sparkSession.createDataFrame(rows, "__s string, t long, n long, weight double, draw long")
    blocks = F.ceil(F.col("n") / block_docs).cast("long")
    made = made.select("__s", F.col("weight").alias("__weight"), F.coalesce(F.expr("draw div t"), F.lit(1).cast("long")).alias("__epochs"), F.coalesce(F.expr("draw % t"), F.lit(0).cast("long")).alias("__rest"), blocks.alias("__blocks"))
    made = materialize(made, "plan")
    small = made if many else F.broadcast(made)
    same = F.col("__src").eqNullSafe(F.col("__s"))
    block = F.pmod("__rank", "__blocks")
    place = hashed(F.lit(seed + 1), "__src", block)
    dealt = slim.join(small, same).select("__s", "__rest", "__rank", "n_tokens", "c", block.alias("b"), place.alias("p"))
    sums = dealt.where("__rest > 0").groupBy("__s", "__rest", "b", "p").agg(F.sum(F.col("n_tokens") * F.col("c")).alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("__s").orderBy("p", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    edge = sums.withColumn("before", before).where("before <= __rest and before + tokens > __rest")
    edge = materialize(edge.select(F.col("__s").alias("es"), F.col("b").alias("eb"), F.col("p").alias("ep"), (F.col("__rest") - F.col("before")).alias("room")), "edges")
    run = F.sum(F.col("n_tokens") * F.col("c")).over(Window.partitionBy("es").orderBy("__rank", "n_tokens"))
    last = dealt.join(edge if many else F.broadcast(edge), F.col("__s").eqNullSafe(F.col("es")) & (F.col("b") == F.col("eb")))
    last = last.withColumn("run", run).where("run <= room").groupBy("es").agg(F.max(F.struct("__rank", "n_tokens")).alias("last"))
    cut = edge.join(last.withColumnRenamed("es", "ls"), F.col("es").eqNullSafe(F.col("ls")), "left").select("es", "eb", "ep", "last")
    full = made.join(cut, F.col("__s").eqNullSafe(F.col("es")), "left").drop("es")
    full = materialize(full, "cuts")
    joined = marked.join(full if many else F.broadcast(full), same)
    at = F.struct(place.alias("p"), block.alias("b"))
    end = F.struct(F.col("ep").alias("p"), F.col("eb").alias("b"))
    inside = F.coalesce(F.struct("__rank", "n_tokens") <= F.col("last"), F.lit(False))
    more = F.when(F.col("ep").isNull(), F.lit(0)).when(at < end, F.lit(1)).when(at == end, inside.cast("int")).otherwise(F.lit(0))
    release(slim, edge)
    return joined.withColumns({"copies": F.col("__epochs") + more, "weight": F.col("__weight")}).select(*names)


def _with_places(docs: DataFrame, source: str, key: str, tokens: Column | None, seed: int) -> DataFrame:
    """docs plus n_tokens, __src and __rank, a document's place in the permutation of its source."""
    src = F.col(source).cast("string")
    words = (tokens if tokens is not None else word_count()).cast("long")
    text = F.coalesce(F.col("text"), F.lit("")) if "text" in docs.columns else F.lit("")
    rank = hashed(F.lit(seed), F.col(key), src, F.md5(text))
    return docs.withColumns({"n_tokens": words, "__src": src, "__rank": rank})


def realise(mixed: DataFrame, columns: list[str], *, source: str = "source", key: str = "doc_id", block_docs: int = 4096, seed: int = 7) -> DataFrame:
    """Rows as often as the mix takes them: in each epoch blocks of about `block_docs` rows of a source in permuted order, and rows in permuted order in them."""
    blocks = mixed.groupBy(F.col(source).cast("string").alias("__s")).agg(F.ceil(F.count("*") / block_docs).cast("long").alias("__blocks"))
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies").cast("long") - 1))
    rows = mixed.where("copies > 0").withColumn("__src", F.col(source).cast("string")).join(blocks, F.col("__src").eqNullSafe(F.col("__s"))).withColumn("__epoch", epochs)
    rows = rows.withColumn("__place", F.xxhash64(F.lit(seed), "__epoch", "__src", F.pmod(F.xxhash64(F.lit(seed), key, "text"), "__blocks")))
    rows = rows.withColumn("__at", F.xxhash64(F.lit(seed + 1), "__epoch", key, "text"))
    return rows.repartition("__place").sortWithinPartitions("__place", "__at").select(*columns)
