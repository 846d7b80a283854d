from __future__ import annotations

import random
from itertools import combinations

import pytest

from glyco.llm import packing
from tests.llm.fixtures import documents, empty, rows


@pytest.mark.parametrize("seed", range(60))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(0, 50), rng.randint(1, 8)))
    counts, buckets = [rng.randint(1, 9) for _ in lengths], rng.randint(1, 5)
    padding = lambda bounds: sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))
    got = packing.best_boundaries(lengths, counts, buckets)
    assert got[-1] == lengths[-1] and len(got) <= buckets and got == sorted(got)
    assert padding(got) == min(padding([*inner, lengths[-1]]) for k in range(min(buckets, len(lengths))) for inner in combinations(lengths[:-1], k))


def test_pack_is_whole(spark):
    got = packing.pack(documents(spark), max_length=100, buckets=4, batch_tokens=500).collect()
    sizes = [(i, len((t or "").encode().split())) for i, t, *_ in rows()]
    assert sum(r.length for r in got) == sum(n for _, n in sizes)
    assert len(got) == sum(max(1, -(-n // 100)) for _, n in sizes)
    bounds = sorted({(r.bucket, r.bucket_length) for r in got})
    assert len({b for b, _ in bounds}) == len(bounds)
    batches: dict = {}
    for r in got:
        assert r.length <= r.bucket_length and r.start == r.piece * 100
        assert all(r.length > b for k, b in bounds if k < r.bucket)
        batches.setdefault((r.bucket, r.batch, r.bucket_length), []).append(r.slot)
    for (bucket, batch, length), slots in batches.items():
        most = max(1, 500 // max(1, length))
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= most
        assert len(slots) == most or batch == max(b for k, b, _ in batches if k == bucket)


def test_empty(spark):
    assert packing.pack(empty(spark)).count() == 0
