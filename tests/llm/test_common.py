import random

import numpy as np
import pytest

from voxlake.llm import common


def test_filter_holds_every_key(spark):
    rng = random.Random(1)
    other = lambda: rng.randrange(-(1 << 63), 1 << 63)
    keys = [0, -1, 1, -(1 << 63), (1 << 63) - 1, *(other() for _ in range(3000))]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    bits = np.frombuffer(common.bit_filter(df, "k"), np.int64)
    assert all(common.in_filter(bits, k) for k in keys)
    some = [*keys, *(other() for _ in range(500))]
    assert common.in_filter_all(bits, np.array(some)).tolist() == [common.in_filter(bits, k) for k in some]
    assert sum(common.in_filter(bits, other()) for _ in range(5000)) < 10
    assert not np.frombuffer(common.bit_filter(df.limit(0), "k"), np.int64).any()


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(n, n + 1) for n in range(100, 160)] + [(500, n) for n in range(501, 560)] + [(900 - n, 899 - n) for n in range(50)] + [(3, 3)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)]
    up = {n: n for e in edges for n in e}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    alone = {a for a, b in edges if a == b} - {n for a, b in edges if a != b for n in (a, b)}
    got = {r.node: r.comp for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: top(n) for n in up if n not in alone}


def test_components_in_parts(spark, monkeypatch):
    """The same components whatever a task holds; a group's edges aren't joined again and again: few rows are written."""
    rng = random.Random(3)
    edges = [(n, n + 1) for n in range(40)] + [(100, 101 + n) for n in range(60)] + [(200 + rng.randrange(50), 200 + rng.randrange(50)) for _ in range(400)]
    df = spark.createDataFrame(edges, "x long, y long")
    written, write = [], common.materialize

    def watched(out, *args, **options):
        out = write(out, *args, **options)
        written.append(out.count())
        return out

    monkeypatch.setattr(common, "materialize", watched)
    want = {(r.node, r.comp) for r in common.components(df, "x", "y").collect()}
    assert len(written) == 2 and written[1] == len(want)  # the edges and the result
    assert {c for _, c in want} == {0, 100, *(c for _, c in want if c >= 200)}
    for most in (5, 64):
        monkeypatch.setattr(common, "EDGES", most)
        assert {(r.node, r.comp) for r in common.components(df, "x", "y").collect()} == want


def test_scratch_folder_needs_a_local_master():
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))})

    session = type("Session", (), {"conf": Conf(), "sparkContext": Context()})()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(session)
