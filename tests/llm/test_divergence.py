import re
from collections import Counter, defaultdict

from tests.llm.cases import empty, frame, make
from voxlake.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs, top=50):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, d, groups = Counter(), Counter(), defaultdict(set)
    for r in rows:
        text, lang, source = (r[i] or "" for i in (1, 2, 3))
        terms = TERM.findall(text.translate(lower))
        groups[lang].add(source)
        n.update((lang, source, t) for t in terms)
        d.update((lang, t) for t in set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for (k, t), c in d.items() if k == lang and c >= min_docs]
        v = len(kept)

        def shares(count):
            total = sum(map(count, kept))
            return {t: 1 + 10**9 * (count(t) + 5) // (total + 5 * v) for t in kept}

        p = {s: shares(lambda t, s=s: n[lang, s, t]) for s in sources}
        q = shares(lambda t: sum(n[lang, s, t] for s in sources))
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if n[lang, s, t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -value, i + 1) for i, (value, _, item) in enumerate(found)]
    return out


def rows_with_more_languages():
    rows = make(120)
    rows += [(5000 + i, f"Stra\u00dfe \u00c9T\u00c9 caf\u00e9 {'only here ' * (i % 5)} x1y2", "zz", f"host{i % 9}", None, None, None, None) for i in range(40)]
    rows += [(6000, "no kept term", "qq", "a", None, None, None, None), (6001, None, "qq", "b", None, None, None, None), (6002, "123 !", "zz", "silent", None, None, None, None), (6003, "alone", "solo", "one", None, None, None, None)]
    return rows


def test_audit_is_brute_force(spark):
    rows = rows_with_more_languages()
    for min_docs, block in ((5, 64), (2, 2), (30, 1)):
        got = sorted(tuple(r) for r in divergence.divergence_audit(frame(spark, rows), min_docs=min_docs, block=block).collect())
        assert got == sorted(brute(rows, min_docs))
    assert {r[2] for r in brute(rows, 5)} == {"pair", "term"}


def test_joint_histograms_hold_every_kept_term(spark):
    rows = rows_with_more_languages()
    audit = divergence.Audit(frame(spark, rows), 5)
    v = {r.lang: r.v for r in audit.langs.collect()}
    seen = Counter()
    for r in divergence.joint_histograms(audit, 3).collect():
        assert r.terms >= 0
        seen[r.lang, r.a, r.b] += r.terms
    assert seen and all(n == v.get(k[0], 0) for k, n in seen.items())


def test_shares_are_exact_beyond_floating_point(spark):
    from pyspark.sql import functions as F

    n, total, v = 4_611_686_018_427_387_904, 9_000_000_000_000_000_123, 12_345
    df = spark.createDataFrame([(n, total, v)], "n long, total long, v long")
    got = df.select(divergence.share(F.col("n"), F.col("total"), F.col("v"), 5, 10**9).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * v)


def test_long_texts_and_parts_of_terms():
    text = "Word\u00e9 " * 300_000 + "x" * 3_000_000 + "-y"
    parts = list(divergence.term_parts(text))
    assert len(parts) > 2 and [t.decode() for p in parts for t in p] == TERM.findall(text.lower())


def test_tables_without_rows(spark):
    assert divergence.divergence_audit(empty(spark)).collect() == []
