import hashlib
import json
from collections import Counter, defaultdict

import pytest

from tests.llm.cases import empty, frame, make
from voxlake.llm import align, vocab

A, B = vocab.default_path(vocab.BYTE_BPE), vocab.default_path(vocab.PIECE_BPE)


def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(texts):
    """Every pair of tokens of a text compared, counts over all texts."""
    a, b = encoders()
    letters = vocab.byte_letters()
    docs, held = [], Counter()
    for t in texts:
        whole = (" " + (t or "")).encode()
        xs, ys, x_ids, y_ids = [], [], [], []
        if t:
            x_ids, y_ids = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            xs = [bytes(letters[c] for c in a.id_to_token(i)) for i in x_ids]
            ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in y_ids]
            if b"".join(xs) != whole or b"".join(ys) != whole:
                xs, ys, x_ids, y_ids = [], [], [], []
        spans = lambda parts: [(sum(map(len, parts[:i])), sum(map(len, parts[: i + 1]))) for i in range(len(parts))]
        sx, sy = spans(xs), spans(ys)
        links = [(x_ids[i], y_ids[j]) for i, (s, e) in enumerate(sx) for j, (u, v) in enumerate(sy) if s < v and u < e]
        ends = sorted({e for _, e in sx} & {e for _, e in sy})
        groups, at = [], 0
        for c in ends:
            part = lambda ids, sp: ",".join(str(i) for i, (s, e) in zip(ids, sp) if at <= s and e <= c)  # noqa: B023, E731
            groups.append(part(x_ids, sx) + "|" + part(y_ids, sy))
            at = c
        docs.append((len(x_ids), len(y_ids), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
        held.update(set(links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return [(na, nb, g, len(k), sum(held[p] == most[p[0]] for p in k), sum(held[p] for p in k), h) for na, nb, g, k, h in docs]


ODD = ["\u2581 is no space here", "<|endoftext|> is text, <s> and <0x41> too", "\u6f22\u5b57\u304b\u306a \u0440\u0443\u0441\u0441\u043a\u0438\u0439 \U0001f600\U0001f44d\U0001f3fd", "tabs\t\tand\n\nlines  and   runs of    spaces ", "a\x00b", "e\u0301 combining", "'s don't we'll"]


def test_alignment_is_brute_force(spark):
    rows = [r for r in make(60) if r[1] is None or len(r[1]) < 1200]
    rows += [(20000 + i, t, None, None, None, None, None, None) for i, t in enumerate(ODD)]
    got = [tuple(r)[1:] + (r.doc_id,) for r in align.align_tokenizers(frame(spark, rows)).collect()]
    want = [w + (r[0],) for w, r in zip(brute([r[1] for r in rows]), rows)]
    key = lambda r: (r[-1] is None, r[-1] or 0, r[:-1])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(w[3] > w[2] + 5 for w in want) and any(w[4] < w[3] for w in want)


def test_groups_with_several_tokens_on_both_sides(spark):
    """Ends that meet only at the last byte go down the staircase."""
    from pyspark.sql import functions as F

    rows = [([1, 2, 3], [2, 5, 9], [4, 5, 6, 7], [1, 3, 6, 9])]
    df = spark.createDataFrame(rows, "a array<int>, ae array<int>, b array<int>, be array<int>")
    got = df.select(align.staircase(F.col("a"), F.col("b"), F.col("ae"), F.col("be"), 100).alias("l")).first().l
    assert got == [104, 105, 205, 206, 306, 307]


def test_empty_and_null_tables(spark):
    assert align.align_tokenizers(empty(spark)).collect() == []
    none = [(1, None, None, None, None, None, None, None), (None, "", None, None, None, None, None, None)]
    assert {tuple(r) for r in align.align_tokenizers(frame(spark, none)).collect()} == {(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")}


def test_long_text_is_whole(spark):
    text = "a long text, with wordings of all kinds " * 12000
    row = align.align_tokenizers(frame(spark, [(1, text, None, None, None, None, None, None)])).first()
    a, b = encoders()
    assert (row.n_a, row.n_b) == (len(a.encode(" " + text).ids), len(b.encode(text))) and row.n_links == row.n_a + row.n_b - row.n_groups


@pytest.mark.parametrize("plain", [True, False])
def test_fast_encoder_is_the_files_own(plain):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(A)
    own.encode_special_tokens = plain
    fast = vocab.ByteLevel(vocab.file_bytes(A), plain=plain)
    assert fast.fast is not None
    for t in [*ODD, *(r[1] for r in make(80) if r[1]), "x" * 20000, " " * 3000 + "y"]:
        assert fast.encode(t) == own.encode(t, add_special_tokens=False).ids
    shuffled = json.loads(vocab.file_bytes(A))
    shuffled["model"]["merges"] = shuffled["model"]["merges"][::-1]
    assert vocab.ByteLevel(json.dumps(shuffled).encode(), plain=plain).fast is None
