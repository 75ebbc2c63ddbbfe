"""Small documents tables with every awkward case, for all operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tkey string, key long, host string"


def make(n=160, seed=3):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(120)]
    line = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage = line(40)
    texts = []
    for i in range(n):
        parts = [line(rng.randint(4, 30)) for _ in range(rng.randint(1, 5))]
        if i % 7 == 0:
            parts.insert(1, passage)
        if i % 5 == 0:
            parts.append("the common footer of this host, all rights")
        if i % 9 == 0:
            parts.append(f"mail me at joe.{i % 4}@mail.example.com or +1 (212) 555-01{i % 90 + 10} from 10.0.{i}.7 card 4111 1111 1111 1111")
        texts.append("\n".join(parts))
    for i in range(0, n // 4):  # near copies, then exact ones
        w = texts[i].split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
        if i % 2:
            texts += [texts[i]] * 3
    odd = ["", None, " ", "\n\n", "one", "two words", "x" * 5000, "rep " * 300, "A\tB\x0bC\x0cD\rE\nF " * 9, "é" * 50, "１２３", "...", passage + " " + passage]
    texts += odd
    rows = [(i, t, "xx" if i % 3 else "yy", f"s{min(i % 6, 3)}", None if t is None else len(t), "clash", i, "h") for i, t in enumerate(texts)]
    rows += [(None, "a row without an id here", None, None, None, None, None, None), rows[5], rows[5], (9000, None, None, None, None, None, None, None)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(make() if rows is None else rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
