from __future__ import annotations

import string

from pyspark.sql import functions as F

from glyco.llm import exact
from tests.llm.fixtures import documents, empty, rows

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute():
    groups: dict = {}
    for r in rows():
        groups.setdefault((r[1] or "").translate(LOWER), []).append(r[0])
    return groups


def test_groups_match_brute_force(spark):
    got = exact.exact_groups(documents(spark), block_bytes=64).collect()
    groups = brute()
    assert len(got) == len(rows())
    want = sorted((str(i), str(max((x for x in ids if x is not None), default=None)), len(ids)) for ids in groups.values() for i in ids)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


def test_names_survive_hash_collisions(spark):
    def weak(block):
        return F.pmod(F.xxhash64(block), F.lit(3)).cast("long")

    named = exact.identities(documents(spark), block_bytes=32, block_hash=weak).collect()
    by_name: dict = {}
    for r in named:
        by_name.setdefault((r.level, r.name), set()).add(r.text_sha256)
    assert all(len(s) == 1 for s in by_name.values())
    assert len(by_name) == len(brute())


def test_drop_keeps_one_row_of_each_text(spark):
    docs = documents(spark)
    kept = exact.drop_exact(docs)
    assert kept.columns == docs.columns
    texts = [(r.text or "").translate(LOWER) for r in kept.collect()]
    assert sorted(texts) == sorted(brute())


def test_empty(spark):
    assert exact.exact_groups(empty(spark)).count() == 0
    assert exact.drop_exact(empty(spark)).count() == 0
