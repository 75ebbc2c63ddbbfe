import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np

from tests.llm.cases import empty, frame, make
from voxlake.llm import pii, quality

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute_quality(text):
    t = text or ""
    words = W.findall(t)
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(wins)
    cover = {i + j for i, w in enumerate(wins) if n[w] > 1 for j in range(8)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if W.search(x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(cover)


def test_quality_counts_and_verdict(spark):
    rows = make()
    got = quality.line_frequency_rules(frame(spark), min_docs=4, share=0.05).collect()
    assert len(got) == len(rows)
    texts = defaultdict(set)
    lines = defaultdict(set)
    for r in rows:
        t = r[1] or ""
        texts[r[3]].add(t)
        for x in t.split("\n"):
            if W.search(x):
                lines[r[3], " ".join(W.findall(x)).lower()].add(t)
    want = []
    for r in rows:
        base = brute_quality(r[1])
        left = base[0]
        for x in (r[1] or "").split("\n"):
            w = W.findall(x)
            if w and len(lines[r[3], " ".join(w).lower()]) > max(4, 0.05 * len(texts[r[3]])):
                left -= len(w)
        failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
        want.append((r[0], *base, failed, not failed and not left < 0.2 * base[0], left))
    key = lambda r: tuple((x is None, x) for x in r)
    have = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.n_words_left) for r in got]
    assert sorted(have, key=key) == sorted(want, key=key)
    assert any(w[8] < w[1] for w in want)


def test_depleted_documents_go(spark):
    rows = [(i, f"{'the shared notice of this very host, with all of its many words in one long line that never ends at all ok'}\nown {i}", None, "s", None, None, None, None) for i in range(40)]
    got = quality.line_frequency_rules(frame(spark, rows)).collect()
    assert {r.kept for r in got} == {False} and {r.base_failed for r in got} == {False}
    copies = [(i, rows[0][1], None, "s", None, None, None, None) for i in range(40)]
    assert {r.kept for r in quality.line_frequency_rules(frame(spark, copies)).collect()} == {True}


def test_keep_good_returns_the_columns(spark):
    out = quality.keep_good(frame(spark))
    assert out.columns == frame(spark).columns
    kept = quality.line_frequency_rules(frame(spark)).where("kept").count()
    assert out.count() == kept


def brute_cut(rows, min_docs, share):
    texts, held = defaultdict(set), defaultdict(set)
    fold = lambda x: " ".join(W.findall(x)).lower()
    for r in rows:
        texts[r[3]].add(r[1] or "")
        for x in (r[1] or "").split("\n"):
            if W.search(x):
                held[r[3], fold(x)].add(r[1])
    often = {k for k, v in held.items() if len(v) > max(min_docs, share * len(texts[k[0]]))}
    return [(r[0], r[1] and "\n".join(x for x in r[1].split("\n") if not W.search(x) or (r[3], fold(x)) not in often), *r[2:]) for r in rows]


def test_frequent_lines_are_cut(spark):
    key = lambda r: tuple((x is None, x) for x in r)
    rows = make()
    rows += [(7000 + i, f"own words of page {i}\n\n  The Common\tFooter of this host,  all rights\nmore {i}", None, None, None, None, None, None) for i in range(8)]
    rows += [(7100 + i, "\n".join(["the only line"] * (i + 1)), None, "t", None, None, None, None) for i in range(8)]
    got = quality.cut_frequent_lines(frame(spark, rows), min_docs=4, share=0.05)
    assert got.columns == frame(spark).columns
    want = brute_cut(rows, 4, 0.05)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert sum(a[1] != b[1] for a, b in zip(rows, want)) > 20 and any(a[1] and b[1] == "" for a, b in zip(rows, want))
    assert quality.cut_frequent_lines(empty(spark)).count() == 0


def test_pipeline_stage_cuts_frequent_lines(spark):
    import corpus_pipeline

    own = [" ".join(f"w{i}x{j}" for j in range(25)) for i in range(20)]
    rows = [(i, f"all rights reserved by this host\n{own[i]}", None, "s", None, None, None, None) for i in range(20)]
    rows += [(99, "all rights reserved by this host\nshort", None, "s", None, None, None, None)]
    got = corpus_pipeline.quality_stage(spark, frame(spark, rows).select(*corpus_pipeline.COLUMNS), "")
    assert sorted((r.doc_id, r.text) for r in got.collect()) == list(enumerate(own))


def test_quality_empty(spark):
    assert quality.line_frequency_rules(empty(spark)).count() == 0


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def brute_spans(t):
    out = [("email", *m.span()) for m in re.finditer(EMAIL, t)]
    out += [("ip", *m.span()) for m in re.finditer(IP, t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(CARD, t):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 16 <= len(d) <= 19:
            s = sum(x if i % 2 == 0 else (2 * x if 2 * x < 10 else 2 * x - 9) for i, x in enumerate(reversed(d)))
            if s % 10 == 0:
                out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(PHONE, t) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def test_base_spans_match_the_patterns():
    odd = [
        "a@b.c", "a@b", "x..y@@b.com", "a@b.c@d.e.f", "@a.b", "a@-.-", "1.2.3.4.5.6.7.8", "1.2.3", "001.2.3.255", "1.2.3.256 4.5.6.7", "1..2.3.4.5", "+12345678", "+1(2)3-4.5 6 7 8 9", "++123456789-",
        "4111 1111 1111 1111", "4111-1111-1111-1111 ", "41111111111111111111", "4111  1111 1111 1111", "+1 4111 1111 1111 1111", "é a.b@c.de ü", "a@b.c.d..e", "me@x.y,you@z.w", "+1 234 567 8901234567890",
    ]
    for t in odd + [r[1] or "" for r in make()]:
        assert [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(t)] == brute_spans(t), t


def test_pii_query_form(spark):
    rows = make()
    got = pii.span_digests(pii.disclosures(frame(spark))).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    more = 0
    for r in got:
        base = brute_spans(text[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert r.spans.startswith(joined)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in base) for x in ("email", "ip", "card", "phone"))
        more += r.n_terms
    assert pii.disclosures(empty(spark)).count() == 0


def test_disclosing_terms(spark):
    """A name that only ever stands by one address discloses it; common words don't."""
    rows = [(i, f"filler{'wxyz'[i]} we wrote to Zebulon at box.seven@mail.example.com about it {i}", None, None, None, None, None, None) for i in range(4)]
    rows += [(100 + i, f"we wrote at noon about it to nobody number{'wxyzabcdefgh'[i % 12]}", None, None, None, None, None, None) for i in range(40)]
    df = frame(spark, rows)
    got = {r.doc_id: r for r in pii.disclosures(df).collect()}
    for i in range(4):
        assert [rows[i][1][x["s"] : x["e"]] for x in got[i].terms] == ["Zebulon"]
        assert got[100 + i].terms is None
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "Zebulon" not in clean[0] and "[EMAIL]" in clean[0] and clean[100] == rows[4][1]
    assert pii.sanitise(df).columns == df.columns


def brute_terms(rows, support=3, sigmas=3, generalise=0.7, remove=0.95):
    """text -> (start, end, action) of its disclosing terms."""
    free, entities = {}, {}
    for t in {r[1] or "" for r in rows}:
        base = pii.base_spans(t)
        entities[t] = pii.entities_of(t, base)
        free[t] = [(m.group().lower(), *m.span()) for m in pii.TERM.finditer(t) if not any(s < m.end() and m.start() < e for _, s, e in base)]
    n_t, n_c, n_ct = Counter(), Counter(), Counter()
    for t in free:
        own = {w for w, _, _ in free[t]}
        n_t.update(own)
        n_c.update(entities[t])
        n_ct.update((c, w) for c in entities[t] for w in own)
    share = {}
    for (c, w), n in n_ct.items():
        chance = n_c[c] * n_t[w] / len(free)
        if n >= support and n >= chance + sigmas * chance**0.5 and n_c[c] < len(free):
            x = math.log(n * len(free) / (n_c[c] * n_t[w])) / math.log(len(free) / n_c[c])
            if x >= generalise:
                share[w] = max(x, share.get(w, 0))
    return {t: [(s, e, "remove" if share[w] >= remove - 1e-12 else "generalise") for w, s, e in free[t] if w in share] for t in free}


def test_entities_of_one_text_are_protected_through_their_classes(spark):
    """Addresses and numbers of one text each: what stands by the kind, the domain or the area only is found, other words aren't."""
    rows = []
    for i in range(200):
        t = f"we wrote at noon about it to nobody number{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 20]}"
        if i % 20 == 0:
            t += f" hotline Wagner at +1 (743) 555-{1000 + i}"
        if i % 20 == 10:
            t += f" postbox of Quimby {'qwertzuiop'[i // 20] * 5}@box{i % 40}.example.com"
        rows.append((i, t, None, None, None, None, None, None))
    got = {r.doc_id: {rows[r.doc_id][1][x["s"] : x["e"]] for x in r.terms or ()} for r in pii.disclosures(frame(spark, rows)).collect()}
    assert got[0] == {"hotline", "Wagner"} and got[10] == {"postbox", "of", "Quimby"} and not any(got[i] for i in range(200) if i % 10)


def test_terms_are_found_in_the_test_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = pii.span_digests(pii.disclosures(docs)).selectExpr("sum(n_terms) n", "count(*) r").first()
    assert got.n > 0 and got.r == docs.count()


def test_wanted_terms_and_places():
    import random

    rng = random.Random(6)
    texts = ["".join(rng.choice("aAbéÉ ßı\n\u00a0\u2003_1²٣.,@İ") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    every = np.full(1 << 14, -1, np.int64)  # a filter that lets all pass
    for text, found in zip(texts, pii.wanted_terms(texts, every)):
        assert found == {m.group(): pii.hash64(m.group().lower().encode()) for m in pii.TERM.finditer(text)}
        base = [(0, a, min(len(text), a + 3)) for a in sorted(rng.sample(range(60), 4)) if a < len(text)]
        spans = [m.span() for m in pii.TERM.finditer(text)]
        assert pii.outside(spans, base) == [(s, e) for _, s, e in pii.free_terms(text, base)]
    assert pii.wanted_terms(["some text", ""], np.zeros(1 << 14, np.int64)) == [{}, {}]
    assert pii.wanted_terms([], every) == []


def test_classes_of_a_value():
    assert pii.classes_of(0, "Jo.Smith7@Mail.example.com") == {"email:jo.smith7@mail.example.com", "email:", "email:@mail.example.com", "email:smith@"}
    assert pii.classes_of(1, "010.0.2.3") == {"ip:010.0.2.3", "ip:", "ip:10.0.2.", "ip:10.0."}
    assert pii.classes_of(2, "4111 1111-1111 1111") == {"card:4111111111111111", "card:", "card:411111-"}
    assert pii.classes_of(3, "+1 (212) 555-0123") == {"phone:12125550123", "phone:", "phone:1212-"}


def test_disclosing_terms_everywhere(spark):
    """A term is counted over whole texts and marked wherever it stands: far from the entity, and without it."""
    far = " ".join(["we wrote at noon about it"] * 30)
    rows = [(i, f"Zebulon {'wxyz'[i] * 5} {far} to box.seven@mail.example.com {far} by Quimby", None, None, None, None, None, None) for i in range(4)]
    rows += [(50, f"we saw Zebulon and QUIMBY at noon {far}", None, None, None, None, None, None), (51, "Quimby alone", None, None, None, None, None, None)]
    rows += [(100 + i, f"{far} to nobody by number{'wxyzabcdefgh'[i % 12]}{'abcdefgh'[i // 12]}", None, None, None, None, None, None) for i in range(60)]
    got = {r.doc_id: [rows[k][1][x["s"] : x["e"]] for x in r.terms or ()] for r in pii.disclosures(frame(spark, rows)).collect() for k in range(len(rows)) if rows[k][0] == r.doc_id}
    assert got[0] == ["Zebulon", "Quimby"] and got[50] == ["Zebulon", "QUIMBY"] and got[51] == ["Quimby"] and not got[100]
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows)).collect()}
    assert not any(w in t.lower() for t in clean.values() for w in ("zebulon", "quimby"))


def test_disclosing_terms_match_brute_force(spark):
    rows = make(90) + [(8000 + i, f"page {w} of joe.1@mail.example.com and 10.0.0.7 by {w} x", None, None, None, None, None, None) for i, w in enumerate(["alpha", "beta", "alpha", "gamma", "beta", "alpha"])]
    rows += [(8100, "alpha and beta elsewhere\nmail", None, None, None, None, None, None)] * 2
    want = brute_terms(rows)
    got = pii.disclosures(frame(spark, rows)).collect()
    text = {r[0]: r[1] or "" for r in rows}
    assert len(got) == len(rows) and sum(map(bool, want.values())) > 5
    for r in got:
        assert [(x["s"], x["e"], x["action"]) for x in r.terms or ()] == want[text[r.doc_id]], r.doc_id


def test_parts_of_identifiers_are_no_terms(spark):
    """Letters inside hex strings and names with digits stand with an entity in every text, and are never marked."""
    assert pii.TERM.findall("ab12 cd_ef x9y hello1 2world Ünïted stay-here a ok. fin") == ["Ünïted", "stay", "here", "ok", "fin"]
    rows = [(i, f"id 7fab{i:04d}cf9 key_ab{i} mail pat@host{i % 3}.example.org", None, None, None, None, None, None) for i in range(12)]
    rows += [(100 + i, f"plain words number {i} of text", None, None, None, None, None, None) for i in range(300)]
    text, want, some = {r[0]: r[1] for r in rows}, brute_terms(rows), 0
    for r in pii.disclosures(frame(spark, rows)).collect():
        got = [(x["s"], x["e"], x["action"]) for x in r.terms or ()]
        assert got == want[text[r.doc_id]], r.doc_id
        assert {text[r.doc_id][s:e] for s, e, _ in got} <= {"id", "mail", "key"}
        some += len(got)
    assert some


def test_the_most_texts_a_line_may_stand_in(spark):
    """In a large host `most_docs` decides, not the share; a line in exactly so many texts stays."""
    rows = []
    for i in range(400):
        lines = [f"own words of document {i} that no other one has at all in this table of texts with more of them {i} {i + 1} {i + 2}"]
        lines += ["a notice that stands in seven texts"] * (i < 7) + ["a notice that stands in eight texts"] * (i < 8) + ["a notice for a fifth of all"] * (i % 5 == 0)
        rows.append((i, "\n".join(lines), None, "big", None, None, None, None))
    found = lambda **o: {r.doc_id: r.n_frequent_lines for r in quality.line_frequency_rules(frame(spark, rows), min_docs=5, share=0.5, **o).collect()}
    assert set(found(most_docs=1000).values()) == {0}
    assert found(most_docs=7) == {i: (i < 8) + (i % 5 == 0) for i in range(400)}
    assert found(most_docs=2) == {i: (i < 7) + (i < 8) + (i % 5 == 0) for i in range(400)}  # never below min_docs
