import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.cases import empty, frame, make
from voxlake.llm import langid, mixing, packing, tokens, topk
from voxlake.llm.common import mix


def brute_top(rows, k, every, scale):
    v = {}
    for i, x, _ in rows:
        if i is not None and x and all(c is not None and np.isfinite(c) for c in x):
            v[i] = np.floor(np.array(x, np.float32).astype(float) * scale).astype(int)
    out = []
    for q in sorted(v):
        if q % every == 0:
            best = sorted(((-int(v[q] @ v[c]), c) for c in v if c != q and len(v[c]) == len(v[q])))[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    return out


def test_top_k(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 5) for _ in range(16)], 0) for i in range(700)]
    rows += [(1000 + i, rows[50][1], 0) for i in range(60)]  # one very common vector
    rows += [(5000, None, 0), (5050, [], 0), (5100, [None] * 16, 0), (5150, [float("nan")] * 16, 0), (5200, [float("inf")] * 16, 0), (None, rows[0][1], 0), (5250, [1.0, 2.0], 0), (5300, [0.0] * 16, 0), rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for options in ({"block": 4096}, {"block": 100, "slice_": 3}):
        got = sorted(tuple(r) for r in topk.exact_top_k(df, **options).collect())
        assert got == brute_top(rows, 5, 50, 256)
    assert topk.exact_top_k(df.limit(0)).count() == 0


def test_top_k_refuses_what_it_cannot_do(spark):
    wide = spark.createDataFrame([(i, [float(1 << 33)] * 64) for i in range(3)], "vec_id long, embedding array<double>")
    with pytest.raises(OverflowError):
        topk.exact_top_k(wide)
    with pytest.raises(ValueError):
        topk.exact_top_k(spark.createDataFrame([(i, [1.0] * (i + 1)) for i in range(5)], "vec_id long, embedding array<double>"), max_dims=3)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    got = langid.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    long_enough = [r for r in got if r.lang_pred != "und"]
    assert len(long_enough) > 150
    assert sum(r.lang_pred == r.lang for r in long_enough) / len(long_enough) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(spark):
    got = {r.doc_id: r for r in langid.identify_languages(frame(spark)).collect()}
    for r in make():
        has = any(c.isalpha() for c in r[1] or "")
        assert (got[r[0]].lang_pred == "und") != has
    assert langid.identify_languages(empty(spark)).count() == 0
    none = frame(spark).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in langid.identify_languages(none).collect()} == {"und"}


def brute_counts(text):
    points = [0]
    for c in text.lower():
        v = ord(c) if "a" <= c <= "z" or ord(c) > 127 and c.isalpha() else 0
        if v or points[-1]:
            points.append(v)
    if points[-1]:
        points.append(0)
    out = np.zeros(langid.DIM)
    for n in range(3):
        for i in range(len(points) - n):
            h = points[i] + 1
            for p in points[i + 1 : i + n + 1]:
                h = (h * 0x9E3779B97F4A7C15 + p + 1) % (1 << 64)
            out[int(mix(np.array([h], np.uint64))[0]) >> (64 - langid.BITS)] += 1
    return out if any(points) else None


def test_counts_in_slices(monkeypatch):
    """Whole texts are counted, whatever the slices."""
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice("ab c.É ß日 ") for _ in range(rng.randint(1, 40)))
        want = brute_counts(text)
        for size in (1, 2, 3, 7, 1 << 18):
            monkeypatch.setattr(langid, "SLICE", size)
            got = langid.counts_of(text)
            assert (got is None) == (want is None) and (got is None or (got == want).all())


def test_nearest_centroid_by_loops(spark):
    """idf, cosines, the choice of the nearest and rejection, against plain loops over the fitted centroids."""
    rows = [("der hund und die katze", "de"), ("die katze und der baum", "de"), ("the dog and the cat", "en"), ("a tree and the dog", "en"), ("the cat", "en")]
    train = spark.createDataFrame([r for r in rows for _ in range(3)], "text string, lang string")
    model = langid.fit(train, per_lang=2)
    docs = [langid.counts_of(t) for t, _ in rows for _ in range(3)]
    df = sum((c > 0).astype(int) for c in docs)
    assert np.allclose(model["idf"], np.log((1 + len(docs)) / (1 + df)) + 1)
    ask = [*(t for t, _ in rows), "the hund", "zzz qqq", "???"]
    got = {r.text: r for r in langid.predict(spark.createDataFrame([(t,) for t in ask], "text string"), model).collect()}
    for t in ask:
        c = langid.counts_of(t)
        if c is None:
            assert got[t].lang_pred == "und" and got[t].score == 0 and got[t].rejected
            continue
        v = np.array([(1 + np.log(x)) * i if x else 0.0 for x, i in zip(c, model["idf"])])
        cosines = [float(v @ m / np.linalg.norm(v)) for m in model["centroids"]]
        best = cosines.index(max(cosines))
        assert got[t].lang_pred == model["langs"][best] and abs(got[t].score - cosines[best]) < 1e-5
        assert got[t].rejected == (1 - cosines[best] > model["radius"][best])
    assert [got[t].lang_pred for t, _ in rows] == [k for _, k in rows] and got["zzz qqq"].rejected
    with pytest.raises(ValueError):
        langid.fit(train, max_langs=1)


def test_mixing(spark):
    docs = frame(spark)
    rows = mixing.mix_sources(docs, block_docs=16).collect()
    assert len(rows) == docs.count()
    assert all(r.copies >= 1 for r in rows if r.source is not None)
    held, got = {}, {}
    for r in rows:
        assert r.n_tokens == len((r.text or "").encode().split())
        held[r.source] = held.get(r.source, 0) + r.n_tokens
        got[r.source] = got.get(r.source, 0) + r.n_tokens * r.copies
    made = mixing.plan(held)
    assert max(v["draw"] / held[k] for k, v in made["sources"].items()) <= 1.5 + 1e-6
    for k, v in made["sources"].items():
        assert got[k] <= v["draw"] and v["draw"] - got[k] <= max(r.n_tokens for r in rows if r.source == k)
    assert mixing.mix_sources(empty(spark)).count() == 0
    twice = mixing.realise(mixing.mix_sources(docs, block_docs=16), docs.columns)
    assert twice.columns == docs.columns and twice.count() == sum(r.copies for r in rows)


def test_mixing_with_names_of_its_own(spark):
    docs = frame(spark).selectExpr("*", "1 weight", "2 copies", "'x' rest", "'y' s", "'z' tokens")
    out = mixing.mix_sources(docs, block_docs=16)
    assert sorted(out.columns) == sorted([*docs.columns, "n_tokens"]) and out.count() == docs.count()


def test_mixing_targets():
    t = {"a": 1000, "b": 100, "c": 10}
    for want in (0.05, 0.7, 1.05):
        e = mixing.plan(t, target_entropy=want)
        assert abs(mixing.entropy([v["weight"] for v in e["sources"].values()]) - want) < 1e-6
    b = mixing.plan(t, budget=500, max_repeat=4)
    assert abs(sum(v["draw"] for v in b["sources"].values()) - 500) <= 3 and b["sources"]["c"]["draw"] <= 40
    assert mixing.plan({"a": 0, None: 0})["sources"] == {}
    for bad in ({"target_entropy": 2.0}, {"target_entropy": -0.1}, {"budget": 10000, "max_repeat": 1.5}):
        with pytest.raises(ValueError):
            mixing.plan({"a": 100, "b": 50}, **bad)
    with pytest.raises(ValueError):
        mixing.plan({"a": 100, "b": 100}, target_entropy=0.1)


def md5_60(*parts):
    return int(hashlib.md5(":".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:15], 16)


def brute_mix(rows, block_docs, seed, **target):
    """(doc_id, source, tokens, copies) by plain loops over blocks in permuted order."""
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((md5_60(seed, r[0], r[3], hashlib.md5((r[1] or "").encode()).hexdigest()), len((r[1] or "").encode().split()), r[0]))
    made = mixing.plan({s: sum(n for _, n, _ in x) for s, x in by.items()}, **target)["sources"]
    out = []
    for s, docs in by.items():
        n_blocks = -(-len(docs) // block_docs)
        held = sum(n for _, n, _ in docs)
        epochs, rest = divmod(made[s]["draw"], held) if s in made else (1, 0)
        blocks = defaultdict(list)
        for d in docs:
            blocks[d[0] % n_blocks].append(d)
        for b in sorted(blocks, key=lambda b: (md5_60(seed + 1, s, b), b)):
            for same in sorted(set(d[:2] for d in blocks[b])):
                group = [d for d in blocks[b] if d[:2] == same]
                tokens = sum(d[1] for d in group)
                take = rest >= tokens and rest > 0
                rest = rest - tokens if take else 0
                out += [(d[2], s, d[1], epochs + take) for d in group]
    return out


def test_mixing_matches_brute_force(spark):
    key = lambda r: tuple((x is None, x) for x in r)
    rows = make()
    for options in ({"block_docs": 16}, {"block_docs": 7, "max_repeat": 1.1}, {"block_docs": 16, "target_entropy": 0.9}, {"block_docs": 16, "max_sources": 1, "max_repeat": 1.2}):
        got = [(r.doc_id, r.source, r.n_tokens, r.copies) for r in mixing.mix_sources(frame(spark), **options).collect()]
        want = brute_mix(rows, seed=7, **{k: v for k, v in options.items() if k != "max_sources"})
        assert sorted(got, key=key) == sorted(want, key=key), options


def test_realised_mix_runs_by_blocks(spark):
    docs = spark.createDataFrame([(i, f"text {i}", f"s{i % 2}") for i in range(200)], "doc_id long, text string, source string")
    out = mixing.realise(docs.selectExpr("*", "2 as copies"), docs.columns, block_docs=10)
    rows = [r.doc_id for r in out.collect()]
    assert sorted(rows) == sorted(list(range(200)) * 2) and not any(a == b for a, b in zip(rows, rows[1:]))


def brute_pack(items, sizes, cost):
    """Best fit by plain loops: (bin of each item, opening sizes, final sizes)."""
    bins, where, clock = [], [], 0  # bin: [room, used, opened, last use]
    for at, n in enumerate(items):
        clock += 1
        fit = [b for b in range(len(bins)) if n and bins[b][0] >= n]
        if fit:
            b = min(fit, key=lambda b: (bins[b][0], -bins[b][3]))
        else:
            best = None
            for s in sorted(sizes):
                if s >= n:
                    held = room = s - n
                    for x in sorted(items[at + 1 :], reverse=True):
                        if 0 < x <= room:
                            room -= x
                    price = cost(s) / max(1, n + held - room)
                    if best is None or price < best[0]:
                        best = price, s
            b = len(bins)
            bins.append([best[1], 0, best[1], clock])
        bins[b][0] -= n
        bins[b][1] += n
        bins[b][3] = clock
        where.append(b)
    return where, [b[2] for b in bins], [min((s for s in sizes if s >= b[1]), key=lambda s: (cost(s), s)) for b in bins]


def test_packing_is_best_fit():
    rng = random.Random(8)
    for sizes, cost in (((16, 32, 64), packing.linear_cost(3)), ((16, 32, 64), lambda s: 4 + s + s * s / 32), ((10, 25, 40, 64), lambda s: 9 + s)):
        for _ in range(12):
            items = sorted((rng.choice((rng.randint(0, 64), rng.randint(1, 9))) for _ in range(rng.randint(1, 90))), reverse=True)
            where, _, opened, final = packing.pack(items, sizes, cost)
            assert (where, opened, final) == brute_pack(items, sizes, cost)


def test_opening_sizes_differ_by_default():
    rng = random.Random(9)
    items = sorted((rng.choice((rng.randint(1, 200), rng.randint(1, 4096))) for _ in range(3000)), reverse=True)
    opened = packing.pack(items)[2]
    assert len(set(opened)) >= 3 and packing.pack([1])[2] == [256]


def test_a_row_that_repeats_very_often_is_spread(spark):
    rows = packing.best_fit_packing(spark.createDataFrame([(7, "a b c")] * 500 + [(None, "a")] * 300, "doc_id long, text string"), shard_docs=100).collect()
    assert len(rows) == 800 and sum(r.n_tokens for r in rows) == 1800
    assert len({r.bin_id >> 32 for r in rows}) > 3


def test_packing(spark):
    rng = random.Random(2)
    items = sorted((rng.randint(1, 64) for _ in range(500)), reverse=True)
    where, offset, opened, final = packing.pack(items, (16, 32, 64))
    assert all(f <= o for o, f in zip(opened, final))
    used = {}
    for n, b, o in zip(items, where, offset):
        assert o == used.get(b, 0)
        used[b] = o + n
    assert all(u <= final[b] and final[b] == min(s for s in (16, 32, 64) if s >= u) for b, u in used.items())
    assert sum(items) / sum(final) > 0.97
    rows = packing.best_fit_packing(frame(spark), sizes=(16, 32), shard_docs=50).collect()
    n = {}
    for r in rows:
        n[r.doc_id] = n.get(r.doc_id, 0) + r.n_tokens
    for r in make():
        if r[0] != 5:
            assert n[r[0]] == len((r[1] or "").encode().split())
    bins = {}
    for r in rows:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append((r.bin_offset, r.n_tokens, r.bin_size))
    for b in bins.values():
        at = 0
        for o, k, size in sorted(b):
            assert o == at
            at += k
        assert at <= size
    assert packing.best_fit_packing(empty(spark)).count() == 0


def test_token_counts(spark):
    enc = tokens.encoding()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in tokens.count_tokens(frame(spark)).collect())
    assert got == sorted((r[0] is None, r[0] or 0, len(enc.encode_ordinary(r[1] or ""))) for r in make())
    assert tokens.count_tokens(empty(spark)).count() == 0


def test_separator_scan_across_blocks(spark, tmp_path):
    rng = np.random.default_rng(5)
    want = []
    for f, (n, p) in enumerate([(1000, 0.01), (997, 0.3), (64, 0.0), (0, 0.5), (128, 1.0)]):
        x = np.where(rng.random(n) < p, 9, 1).astype("<u4")
        (tmp_path / f"{f}.bin").write_bytes(x.tobytes())
        prev, k = -1, 0
        for g in np.flatnonzero(x == 9):
            want.append((f, k, prev + 1, int(g - prev - 1), True))
            prev, k = int(g), k + 1
        if prev + 1 < n:
            want.append((f, k, prev + 1, n - prev - 1, False))
    files = tokens.list_token_files(spark, f"file://{tmp_path}")
    got = [(int(r.file.rpartition("/")[2][:-4]), r.ordinal, r.start, r.n_tokens, r.terminated) for r in tokens.scan_separators(files, eod=9, dtype="<u4", block_tokens=50).collect()]
    assert sorted(got) == sorted(want)
