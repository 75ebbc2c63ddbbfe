import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import empty, frame, make
from voxlake.llm import substrings

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    words = [W.findall(r[1] or "") for r in rows]
    n = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for r, w in zip(rows, words):
        gone = {i + j for i in range(len(w) - width + 1) if n[tuple(w[i : i + width])] > 1 for j in range(width)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


key = lambda r: tuple((x is None, x) for x in r)


@pytest.mark.parametrize("options", [{}, {"bound": 3, "shard_words": 300}, {"width": 12, "gram": 4, "bound": 5}])
def test_repeats(spark, options):
    rows = make()
    got = [tuple(r) for r in substrings.kept_digests(frame(spark, rows), **options).collect()]
    want = brute(rows, options.get("width", 35))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(r[2] for r in want)


def test_empty(spark):
    assert substrings.kept_digests(empty(spark)).count() == 0


def test_index_against_counting():
    rng = random.Random(7)
    for _ in range(40):
        segs = [np.array([rng.randint(1, 3) for _ in range(rng.randint(5, 14))], np.uint64) for _ in range(rng.randint(1, 12))]
        weight = np.array([rng.randint(1, 2) for _ in segs])
        n = Counter()
        for s, w in zip(segs, weight):
            for i in range(len(s) - 4):
                n[tuple(s[i : i + 5])] += int(w)
        for s, mask in zip(segs, substrings.repeated_windows(segs, weight, 5)):
            assert mask.tolist() == [n[tuple(s[i : i + 5])] > 1 for i in range(len(s) - 4)]
