"""How far apart the sources of a language are, by joint histograms of term counts.

Terms are counted once over the texts, in parts that a task adds up before the shuffle. A language keeps the terms of at
least `min_docs` of its documents. A group, a source of a language, gives a kept term of n occurrences the integer share
p(n) = 1 + floor(scale * (n + smooth) / (N + smooth * V)), N the group's occurrences of the V kept terms.

Two groups differ by the sum of |p - q| over all kept terms. As shares depend on counts only, a pair of groups needs no more
than its joint histogram: how many terms have n occurrences here and m there. Terms that both groups hold are tallied
from lists of the groups of each term; the cells with a zero follow from each group's own histogram less what was
tallied, and the cell (0, 0) from V. The function is evaluated once a cell and multiplied by the terms in it.

Sources of a language are numbered and dealt into blocks of `block`; a term's groups are listed by block and lists meet
by pairs of blocks, so no list grows with the number of sources. All arithmetic is in integers and exact decimals.

Defined results: null text, lang and source are ''; a group without terms takes part with counts of zero; a language
without kept terms has distances of 0 and no rows of part `term`; a language of one source has no pairs; repeated rows
count each; ties go to the smaller item by UTF-8; long texts are taken whole, in parts of about a
megabyte; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, batches_of, materialize, pieces, release

MIN_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Sources of a language that are listed together.
BLOCK = 64
#: Terms a task holds before it hands its counts on.
HELD = 200_000
#: A-Z become a-z; bytes that stand in no term become spaces. Bytes from 128 on are parts of letters that aren't ASCII.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_parts(text: str, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text, in parts."""
    data = text.encode().translate(FOLD)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; a row with a null term for every group there is."""
    ddl = "lang string, source string, term string, n long, docs long"
    schema = arrow_schema(ddl)

    def run(it):
        seen: set[tuple[str, str]] = set()
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> Iterator[tuple]:
            for (lang, source), (n, d) in held.items():
                yield from ((lang, source, t.decode(), c, d[t]) for t, c in n.items())

        for b in pieces(it):
            for text, lang, source in zip(*(c.to_pylist() for c in b.columns)):
                group = (lang, source)
                if group not in seen:
                    seen.add(group)
                    yield from batches_of(iter([(lang, source, None, 0, 0)]), schema)
                if not text:
                    continue
                n, d = held.setdefault(group, (Counter(), Counter()))
                own: set[bytes] = set()
                for terms in term_parts(text):
                    n.update(terms)
                    own.update(terms)
                d.update(own)
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from batches_of(rows(), schema)
                held.clear()
        yield from batches_of(rows(), schema)

    read = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    return read.mapInArrow(run, ddl).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column, smooth: int, scale: int) -> Column:
    """1 + floor(scale * (n + smooth) / (total + smooth * terms)), exactly, for sums of any size that a long holds."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(scale).cast("decimal(10,0)") * whole(n + smooth), whole(total + terms * smooth)) + 1


class Audit:
    """Tables that both parts read, written once: counts of kept terms, groups, languages.

    kept (lang, term, n); cells (lang, sid, term, n); groups (lang, source, sid, v, n_terms, total, lang_total); langs (lang, v, total).
    """

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS) -> None:
        counts = materialize(count_terms(docs), "term-counts")
        named = counts.where("term is not null")
        self.kept = materialize(named.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term", "n"), "kept-terms")
        v = self.kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("total"))
        number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # a row a source
        ids = materialize(counts.where("term is null").select("lang", "source").withColumn("sid", number), "sources")
        held = named.where("n > 0").join(self.kept.select("lang", "term"), ["lang", "term"])
        self.cells = materialize(held.join(ids, ["lang", "source"]).select("lang", "sid", "term", "n"), "cells")
        totals = self.cells.groupBy("lang", "sid").agg(F.count("*").alias("n_terms"), F.sum("n").alias("total"))
        whole = ids.join(v.withColumnRenamed("total", "lang_total"), "lang", "left").join(totals, ["lang", "sid"], "left")
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        self.groups = materialize(whole.select("lang", "source", "sid", zero("v"), zero("n_terms"), zero("total"), zero("lang_total")), "groups")
        self.langs = v
        release(counts, ids)


def joint_histograms(audit: Audit, block: int = BLOCK) -> DataFrame:
    """(lang, a, b, n_a, n_b, terms) for sources a < b: how many kept terms have n_a occurrences in a and n_b in b, zeros included."""
    listed = audit.cells.groupBy("lang", "term", F.floor(F.col("sid") / block).alias("blk")).agg(F.sort_array(F.collect_list(F.struct("sid", "n"))).alias("l"))
    listed = materialize(listed, "term-lists")
    here, there = (listed.select("lang", "term", F.col("blk").alias(k), F.col("l").alias(f"l{k}")) for k in "xy")
    met = here.join(there, ["lang", "term"]).where("x <= y")
    two = met.select("lang", F.explode("lx").alias("p"), "ly").select("lang", "p", F.explode("ly").alias("q")).where("p.sid < q.sid")
    both = two.groupBy("lang", F.col("p.sid").alias("a"), F.col("q.sid").alias("b"), F.col("p.n").alias("n_a"), F.col("q.n").alias("n_b")).agg(F.count("*").alias("terms"))

    # A term that both hold leaves the zero cells that its groups' own histograms put it into.
    zero = F.lit(0).cast("long")
    cell = lambda n_a, n_b, terms: F.struct(n_a.alias("n_a"), n_b.alias("n_b"), terms.alias("terms"))
    a, b, t = F.col("n_a"), F.col("n_b"), F.col("terms")
    tallied = both.select("lang", "a", "b", F.explode(F.array(cell(a, b, t), cell(a, zero, -t), cell(zero, b, -t), cell(zero, zero, t))).alias("c"))
    own = materialize(audit.cells.groupBy("lang", "sid", "n").agg(F.count("*").alias("terms")), "own-histograms")
    side = lambda k, name: audit.groups.select("lang", F.col("sid").alias(name), *([F.col("v")] if k else []))
    pairs = side(1, "a").join(side(0, "b"), "lang").where("a < b")
    n = F.col("n")
    left = own.withColumnRenamed("sid", "a").join(side(0, "b"), "lang").where("a < b").select("lang", "a", "b", F.explode(F.array(cell(n, zero, t), cell(zero, zero, -t))).alias("c"))
    right = own.withColumnRenamed("sid", "b").join(side(0, "a"), "lang").where("a < b").select("lang", "a", "b", F.explode(F.array(cell(zero, n, t), cell(zero, zero, -t))).alias("c"))
    none = pairs.select("lang", "a", "b", cell(zero, zero, F.col("v")).alias("c"))
    cells = tallied.unionByName(left).unionByName(right).unionByName(none)
    return cells.groupBy("lang", "a", "b", F.col("c.n_a").alias("n_a"), F.col("c.n_b").alias("n_b")).agg(F.sum("c.terms").alias("terms")).where("terms > 0 or (n_a = 0 and n_b = 0)")


def source_distances(audit: Audit, *, smooth: int = SMOOTH, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of sources of a language."""
    side = lambda k: audit.groups.select("lang", F.col("sid").alias(k), F.col("source").alias(f"source_{k}"), F.col("total").alias(f"total_{k}"), *([F.col("v")] if k == "a" else []))
    of = lambda k: share(F.col(f"n_{k}"), F.col(f"total_{k}"), F.col("v"), smooth, scale)
    cells = joint_histograms(audit, block).join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"])
    # Without kept terms there is nothing to share; the one cell of such a pair holds no term.
    f = F.when(F.col("v") > 0, F.abs(of("a") - of("b")) * F.col("terms")).otherwise(0)
    summed = cells.groupBy("lang", "source_a", "source_b").agg(F.sum(f).alias("value"))
    both = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))).alias("o")
    return summed.select("lang", both, "value").select("lang", "o.source", "o.item", "value")


def telling_terms(audit: Audit, *, smooth: int = SMOOTH, scale: int = SCALE) -> DataFrame:
    """(lang, source, item, value): terms that a source has a larger share of than its language."""
    group = audit.groups.select("lang", "sid", "source", "v", "total", "lang_total")  # nothing is joined by language alone
    of_lang = audit.kept.select("lang", "term", F.col("n").alias("lang_n"))
    rows = audit.cells.join(of_lang, ["lang", "term"]).join(group, ["lang", "sid"])
    value = share(F.col("n"), F.col("total"), F.col("v"), smooth, scale) - share(F.col("lang_n"), F.col("lang_total"), F.col("v"), smooth, scale)
    return rows.select("lang", "source", F.col("term").alias("item"), value.alias("value")).where("value > 0")


def divergence_audit(docs: DataFrame, *, min_docs: int = MIN_DOCS, smooth: int = SMOOTH, scale: int = SCALE, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): each source's distances to the others (`pair`) and its foremost terms (`term`)."""
    audit = Audit(docs, min_docs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    pairs = ranked(source_distances(audit, smooth=smooth, scale=scale, block=block), "pair")
    return pairs.unionByName(ranked(telling_terms(audit, smooth=smooth, scale=scale), "term").where(F.col("rank") <= top))
