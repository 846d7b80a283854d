from __future__ import annotations

import hashlib
import random
import string
import zlib

from glyco.llm import merkle
from tests.llm.fixtures import documents, empty

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    told = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in told))


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + 8])) for i in range(0, len(now), 8)])
    return levels


def path(levels, i, value):
    """Siblings from place ``i`` to the root, and the root that ``value`` gives there."""
    proof = ""
    for level in levels[:-1]:
        run = list(range(i // 8 * 8, min(i // 8 * 8 + 8, len(level))))
        proof += "".join(level[j] for j in run if j != i)
        value, i = sha("".join(value if j == i else level[j] for j in run)), i // 8
    return proof, value


def brute(rows):
    groups: dict = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        ordered = sorted(groups[lang], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text)))
        trees.append((ordered, levels_of([leaf_of(r, r.text) for r in ordered])))
    top = levels_of([levels[-1][0] for _, levels in trees])
    out = []
    for t, (ordered, levels) in enumerate(trees):
        for i, r in enumerate(ordered):
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            text = r.text.translate(LOWER) if tampered and r.text is not None else r.text
            low, value = path(levels, i, leaf_of(r, text))
            high, value = path(top, t, value)
            out.append((r.doc_id, levels[0][i], levels[-1][0], top[-1][0], sha(low + high), value, value == top[-1][0]))
    return sorted(out, key=str)


def test_manifest_matches_brute_force(spark):
    base = documents(spark).collect()
    rng = random.Random(3)
    rows = []
    for k, r in enumerate(base * 2):  # repeated rows, upper case, a hot language, null and lone ones
        lang = rng.choice(["en", "en", "en", "de", None, "Ünï", f"alone{k}"])
        text = r.text.title() if r.text is not None and k % 2 else r.text
        rows.append((r.doc_id, text, r.source, lang, 2**60 + k % 3, "clash"))
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, source string, lang string, n_chars long, tree string")
    want = brute(docs.collect())
    assert not all(w[-1] for w in want) and any(w[-1] for w in want)
    for leaves in (16, 4096):
        got = sorted((tuple(r) for r in merkle.manifest(docs, leaves).collect()), key=str)
        assert got == want


def test_large_ids_beside_null_ids(spark):
    rows = [(2**62 + 1, "A", "s", "en", 1), (None, "b", "s", "en", None)]
    got = merkle.manifest(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")).collect()
    assert {r.doc_id for r in got} == {2**62 + 1, None}


def test_lone_row_and_empty_table(spark):
    row = spark.createDataFrame([(None, None, None, None, None)], "doc_id long, text string, source string, lang string, n_chars long")
    [got] = merkle.manifest(row).collect()
    assert got.leaf == got.subroot == got.root == got.folded_root == sha("-----") and got.proof_sha256 == sha("") and got.verified
    assert merkle.manifest(empty(spark)).count() == 0


def test_multiproof_is_minimal():
    rng = random.Random(1)
    for n in (1, 2, 8, 9, 64, 65, 700):
        sizes = merkle.level_sizes(n)
        for _ in range(20):
            chosen = sorted(rng.sample(range(n), rng.randint(1, min(n, 30))))
            needed = set()
            inner = set(enumerate([]))
            known = set(chosen)
            for level, size in enumerate(sizes[:-1]):  # siblings of single proofs, less what other leaves derive
                inner |= {(level, k) for k in known}
                for k in known:
                    needed |= {(level, i) for i in range(k // 8 * 8, min(k // 8 * 8 + 8, size))}
                known = {k // 8 for k in known}
            assert set(merkle.missing(n, chosen)) == needed - inner
            first, last = min(chosen), max(chosen)
            assert sorted(merkle.missing_of_range(n, first, last)) == sorted(merkle.missing(n, list(range(first, last + 1))))
