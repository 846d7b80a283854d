from __future__ import annotations

import numpy as np
import pytest
import xxhash

from glyco.llm import simhash
from glyco.llm.components import components
from tests.llm.fixtures import documents, empty, prose, rows


def brute_print(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - 3)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def brute_components(prints: list[tuple[int, int]]) -> dict:
    ids = sorted(prints)
    root = {i: i for i, _ in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, f) in enumerate(ids):
        for j, g in ids[:k]:
            if (f ^ g).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in ids}


@pytest.mark.parametrize("text", [None, "", "One", "a B c", "a b c d", prose(500, 3), "ä ö ü x y"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_print(text)


def near(rng, base: int, most: int = 4) -> int:
    for b in rng.choice(64, rng.integers(0, most + 1), replace=False):
        base ^= 1 << int(b)
    return base


@pytest.mark.parametrize("radius", [1, 3, 4, 7])
def test_bit_sliced_pairs(radius):
    rng = np.random.default_rng(radius)
    prints = np.array([near(rng, int(b), 6) for b in rng.integers(0, 1 << 62, 12) for _ in range(25)], dtype=np.uint64)
    ends = np.repeat([70, 71, 200, 300], [70, 1, 129, 100])
    got = {p for a, b in simhash.close_pairs(prints, ends, radius) for p in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(300) for j in range(i + 1, ends[i]) if int(prints[i] ^ prints[j]).bit_count() <= radius}
    assert got == want


@pytest.mark.parametrize("block_rows", [8192, 40])
def test_links_connect_all_within_radius(spark, block_rows):
    rng = np.random.default_rng(7)
    prints = sorted({near(rng, int(b)) for b in rng.integers(0, 1 << 63, 15) for _ in range(20)} | {near(rng, 5) for _ in range(150)})
    rows = [(k + 10, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(prints)]
    found = simhash.links(spark.createDataFrame(rows, "node long, fingerprint long"), block_rows=block_rows)
    got = {r.node: r.component for r in components(found).collect()}
    want = brute_components([(n, p % (1 << 64)) for n, p in rows])
    assert {n: got.get(n, n) for n in want} == want


def test_components_of_chain_and_hub(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 160)}


def test_groups(spark):
    docs = documents(spark)
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_groups(docs).collect()}
    prints = {(i, brute_print(t)) for i, t, *_ in rows()}
    assert {(i, int(f, 16)) for i, f in got} == prints
    want = brute_components([p for p in prints if p[0] is not None])
    assert all(got[i, f"{p:016x}"] == want[i] for i, p in prints if i is not None)
    kept = simhash.drop_near(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))


def brute_groups(pairs, radius=4):
    """Component of every (doc_id, fingerprint): near fingerprints link, and those of one doc_id."""
    nodes = sorted({p for _, p in pairs})
    of_id: dict = {}
    for i, p in pairs:
        if i is not None:
            of_id.setdefault(i, set()).add(p)
    group = {p: {p} for p in nodes}

    def join(a, b):
        if group[a] is not group[b]:
            group[a] |= group[b]
            for p in group[b]:
                group[p] = group[a]

    for a in nodes:
        for b in nodes:
            if (a ^ b).bit_count() <= radius:
                join(a, b)
    for prints in of_id.values():
        for p in prints:
            join(min(prints), p)
    return {p: min((i for i, q in pairs if i is not None and q in group[p]), default=None) for p in nodes}


def test_ids_that_are_missing_or_reused_link(spark, monkeypatch):
    """A row without an id bridges two documents; a document with two texts belongs to one group."""
    rng = np.random.default_rng(11)
    base = [int(x) for x in rng.integers(0, 1 << 62, 40)]
    pairs = [(5, base[0]), (None, base[0] ^ 0b1111), (7, base[0] ^ 0b11111111)]  # 5 and 7 are 8 bits apart
    pairs += [(1, base[1]), (2, base[1]), (2, base[2]), (3, base[2]), (None, base[3])]
    for b in base[4:]:
        start = int(rng.integers(0, 60))
        for k in range(int(rng.integers(1, 6))):
            i = int(rng.integers(20, 60))
            pairs.append((None if i % 3 == 0 else i, b ^ (((1 << 4) - 1) << (start + k) % 60 if k % 2 else 0)))
    rows_of = spark.createDataFrame([(i, p) for i, p in pairs], "doc_id long, fingerprint long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, width: docs)
    got = simhash.near_groups(rows_of).collect()
    want = brute_groups(pairs)
    assert len(got) == len(pairs)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == sorted((str(i), f"{p:016x}", str(want[p])) for i, p in pairs)
    assert want[base[0] ^ 0b11111111] == 5 and want[base[2]] == 1 and want[base[3]] is None


def test_rows_with_missing_and_reused_ids_stay(spark):
    """Only near texts go: five without a doc_id, three under one doc_id, and copies of both kinds."""
    texts = [(None, prose(80, 50 + k)) for k in range(5)] + [(7, prose(80, 60 + k)) for k in range(3)]
    copies = [(None, prose(80, 50)), (None, prose(80, 60)), (9, prose(80, 61))]
    kept = simhash.drop_near(spark.createDataFrame(texts + copies, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted((i or 0, t) for i, t in texts)


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()}


def replaced(text, places, mark):
    words = text.split()
    for p in places:
        words[p] = f"{mark}{p}"
    return " ".join(words)


@pytest.mark.parametrize("part", [4096, 7])
def test_long_fingerprint(monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    text = prose(700, 3) + " " + prose(300, 3)  # shingles that repeat count once
    h = sorted({xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles(text)})

    def mixed(x, k):
        x = (x + k * 0x9E3779B97F4A7C15) % (1 << 64)
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
        x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
        return x ^ x >> 31

    got, keys = simhash.long_fingerprint(text)
    bits = int.from_bytes(got, "little")
    for k in range(simhash.LONG_WORDS):
        each = [mixed(x, k + 1) for x in h]
        assert [bits >> 64 * k + b & 1 for b in range(64)] == [2 * sum(x >> b & 1 for x in each) > len(h) for b in range(64)]
    least = [min(mixed(x, k + 1 + simhash.LONG_WORDS) for x in h) for k in range(simhash.BANDS * simhash.BAND_ROWS)]
    bands = [least[i : i + simhash.BAND_ROWS] for i in range(0, len(least), simhash.BAND_ROWS)]
    assert [k % (1 << 64) for k in keys] == [xxhash.xxh64_intdigest(b"".join(x.to_bytes(8, "little") for x in band)) for band in bands]
    assert simhash.long_fingerprint(" \t") == simhash.long_fingerprint(None) == (bytes(128), [0] * simhash.BANDS)


def test_bit_sliced_pairs_of_long_fingerprints():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, (200, simhash.LONG_WORDS)).astype(np.uint64)
    for i in range(1, 200):
        if i % 10:
            prints[i] = prints[i - 1]
            for b in rng.choice(1024, rng.integers(0, 120), replace=False):
                prints[i, b // 64] ^= np.uint64(1 << int(b) % 64)
    values = [int.from_bytes(p.tobytes(), "little") for p in prints]
    got = {p for a, b in simhash.close_pairs(prints, np.full(200, 200), 172) for p in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if (values[i] ^ values[j]).bit_count() <= 172}
    assert got == want and len(want) > 100


@pytest.mark.parametrize("words, changed", [(60, 1), (200, 4), (600, 12)])
def test_recall_of_similar_texts(words, changed):
    rng, found, near_pairs, false, far = np.random.default_rng(words), 0, 0, 0, 0
    radius = simhash.radius_of(simhash.SIMILARITY)
    for k in range(100):
        text = prose(words, 5000 + k)
        for many in (changed, 4 * changed):
            other = replaced(text, rng.choice(words, many, replace=False), "x")
            a, b = shingles(text), shingles(other)
            (p, u), (q, v) = simhash.long_fingerprint(text), simhash.long_fingerprint(other)
            met = any(x == y for x, y in zip(u, v)) and (int.from_bytes(p, "little") ^ int.from_bytes(q, "little")).bit_count() <= radius
            if len(a & b) >= simhash.SIMILARITY * len(a | b):
                near_pairs, found = near_pairs + 1, found + met
            elif len(a & b) < 0.6 * len(a | b):
                far, false = far + 1, false + met
    assert near_pairs >= 90 and found >= 0.97 * near_pairs
    assert far >= 50 and false == 0


def test_one_of_each_similar_group_stays(spark):
    """Groups of near copies, chains of them, texts that share half, and every awkward row."""
    texts = [(i, t) for i, t, *_ in rows() if i != 7]
    for k in range(12):
        base = prose(150, 9000 + k)
        texts += [(1000 + 20 * k + j, replaced(base, [37 * j % 150] if j else [], "near")) for j in range(k)]
        texts += [(2000 + k, base[: len(base) // 2] + " " + prose(75, 9500 + k))]
    ids, sets = [i for i, _ in texts], [shingles(t) for _, t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            assert not 0.7 < j < 0.8  # the fixture has no case that an estimate may decide either way
            if j >= 0.8 and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    want = {min((ids[k] is None, ids[k] or 0) for k in range(len(ids)) if group[k] == g) for g in group}
    docs = spark.createDataFrame([(i, t, 1, "y") for i, t in texts], "doc_id long, text string, keys int, _sha string")
    kept = simhash.drop_similar(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(want)


def test_large_blocks_of_similar_texts_are_cut(spark):
    base = prose(120, 77)
    texts = [replaced(base, [k % 118], f"v{k}-") for k in range(90)] + [prose(120, 8000 + k) for k in range(30)]
    made = [simhash.long_fingerprint(t) for t in texts]
    nodes = spark.createDataFrame([(k, bytearray(p), keys) for k, (p, keys) in enumerate(made)], "node long, fingerprint binary, keys array<long>")
    radius = simhash.radius_of(simhash.SIMILARITY)
    each = [{r.node: r.component for r in components(simhash.band_links(nodes, radius, block_rows=n)).collect()} for n in (8192, 20)]
    assert each[0] == each[1] == {k: 0 for k in range(90)}


def test_missing_and_reused_ids_of_similar_texts_stay(spark):
    texts = [(None, prose(80, 50 + k)) for k in range(5)] + [(7, prose(80, 60 + k)) for k in range(3)]
    copies = [(None, prose(80, 50)), (None, prose(80, 60)), (9, prose(80, 61).upper())]
    kept = simhash.drop_similar(spark.createDataFrame(texts + copies, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted((i or 0, t) for i, t in texts)


def test_empty(spark):
    assert simhash.drop_similar(empty(spark)).count() == 0
    assert simhash.near_groups(empty(spark)).count() == 0
    assert simhash.drop_near(empty(spark)).count() == 0
