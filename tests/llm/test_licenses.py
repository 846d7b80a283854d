from __future__ import annotations

import re

from glyco.llm import licenses
from tests.llm.fixtures import documents, empty, rows

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    "Licensed under the Apache License, Version 2.0.",
    "This is under the MIT-License; mit license MIT\nLICENSE mitt license submit license",
    "GNU General Public License v3 and the Lesser General Public License, version 2.1",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this. MIT License",
    "SPDX-License-Identifier: Apache-2.0",
    "nothing to see, Ä license of its own",
    "mit Lizenz",
    "All rights reserved. " * 50 + "Eclipse Public License 2.0",
    "apache license " * 3000,
    "BSD 3-Clause License and BSD License",
    None,
    "",
]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text):
    """Every rule over every word start, then suppression pair by pair."""
    words = WORDS.findall(lower(text))
    joined = " " + " ".join(words) + " "
    base = sorted((i, label) for phrase, label in licenses.BASE for n in [phrase.split()] for i in range(len(words) - len(n) + 1) if words[i : i + len(n)] == n)
    hits = [(i, i + len(p.split()), 3, k, label) for k, (p, label) in enumerate(licenses.BASE) for j, l in base if l == label for i in [j]]
    for k, (label, priority, _, _, pattern) in enumerate(licenses.rules(), len(licenses.BASE)):
        for m in re.finditer(rf"(?<= )(?:{pattern})(?= )", joined):
            start = joined[: m.start()].count(" ") - 1
            hits.append((start, start + m[0].count(" ") + 1, priority, k, label))
    kept = [
        a for a in hits
        if a[3] < len(licenses.BASE)
        or not any(b is not a and b[0] <= a[0] and b[1] >= a[1] and (b[2] > a[2] or (b[2] == a[2] and (b[1] - b[0] > a[1] - a[0] or b[3] < a[3]))) for b in hits)
    ]
    covered = {w for s, e, *_ in kept for w in range(s, e)}
    return {
        "n_words": len(words), "n_base": len(base), "first_word": min((i for i, _ in base), default=None), "last_word": max((i for i, _ in base), default=None),
        "base_labels": ",".join(sorted({x for _, x in base})), "labels": ",".join(sorted({h[4] for h in kept})), "score": len(covered) / len(words) if words else 0.0,
    }


def test_scan_matches_brute_force(spark):
    texts = [t for t in TEXTS if not t or len(t) < 20_000] + [t for _, t, *_ in rows() if len(t or "") < 20_000]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        assert abs(r.score - want.pop("score")) < 1e-9
        assert {k: r[k] for k in want} == want, texts[r.doc_id]


def test_many_places_in_a_long_text(spark):
    row = licenses.scan(spark.createDataFrame([(1, TEXTS[8])], "doc_id long, text string")).first()
    assert (row.n_base, row.first_word, row.last_word, row.base_labels) == (3000, 0, 5998, "apache")


def test_hundreds_of_rules_whose_keywords_stand_in_their_matches():
    found = licenses.rules()
    assert len(found) > 300 and len({p for *_, p in found}) > 300
    for _, priority, first, second, pattern in found:
        assert 0 <= priority < licenses.LEVELS
        assert first in pattern.replace("licen[cs]e", "license").replace(" ?", "") and second in pattern.replace("?", ""), (first, second, pattern)
        assert second and licenses.literal(second) == second


def test_messy_and_empty_tables(spark):
    assert licenses.scan(documents(spark)).count() == len(rows())
    assert licenses.scan(empty(spark)).count() == 0
