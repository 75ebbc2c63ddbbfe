import random
import zlib
from collections import defaultdict

import numpy as np

from tests.llm.cases import empty, frame, make
from voxlake.llm import ffd, vocab


def brute_first_fit(lengths, capacity):
    bins, room = [], []
    for i, n in enumerate(lengths):
        b = next((b for b, r in enumerate(room) if r >= n), None)
        if b is None:
            b = len(bins)
            bins.append([])
            room.append(capacity)
        bins[b].append(i)
        room[b] -= n
    return bins


def test_tournament_is_first_fit():
    rng = random.Random(4)
    for _ in range(200):
        cap = rng.choice([8, 64, 1024])
        lengths = sorted((rng.randint(1, cap) for _ in range(rng.randint(0, 120))), reverse=True)
        assert ffd.first_fit(lengths, cap) == brute_first_fit(lengths, cap)


def test_cuts_lose_nothing_and_pad_little():
    rng = random.Random(5)
    for _ in range(200):
        lengths = sorted((rng.randint(1, 1024) if rng.random() < 0.5 else rng.randint(600, 800) for _ in range(rng.randint(0, 150))), reverse=True)
        least = rng.choice([1, 16, 64])
        out = ffd.pack(lengths, 1024, least)
        got = defaultdict(list)
        for b in out:
            assert 0 < sum(p[2] for p in b) <= 1024
            for i, s, n in b:
                assert n > 0
                got[i].append((s, n))
        for i, n in enumerate(lengths):
            at = 0
            for s, k in sorted(got[i]):
                assert s == at
                at += k
            assert at == n
        assert all(ffd.padded(sum(p[2] for p in b), 1024) < least for b in out)


def check(rows, got, plain=False, length=1024):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocab.default_path(vocab.BYTE_BPE))
    want = defaultdict(list)
    for r in rows:
        want[r[0]].append([*own.encode(r[1] or "", add_special_tokens=False).ids, 0])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for d, ids in want.items():
        if len(ids) > 1:  # rows of one id: their pieces are told apart by no column
            assert sum(r.length for r in pieces[d]) == sum(map(len, ids))
            continue
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[0])
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[0][r.start : r.start + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[0])
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length


def test_packing_round_trip(spark):
    rows = make() + [(20000, "special <|endoftext|> inside", None, None, None, None, None, None), (20001, "long text of words " * 30000, None, None, None, None, None, None)]
    got = ffd.first_fit_packing(frame(spark, rows)).collect()
    check(rows, got)
    small = ffd.first_fit_packing(frame(spark, rows), group_pieces=10).collect()
    check(rows, small)
    assert len({r.sequence_id >> 32 for r in small}) > 5
    again = ffd.first_fit_packing(frame(spark, rows), length=100, least_cut=8).collect()
    check(rows, again, length=100)


def test_empty_table(spark):
    assert ffd.first_fit_packing(empty(spark)).collect() == []
