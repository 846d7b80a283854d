from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyco.llm import quality
from tests.llm.fixtures import documents, empty, prose, rows

FOLDER = "/root/testdata/sf0.01"


def brute_repeats(words):
    n = max(0, len(words) - 7)
    seen: dict = {}
    for i in range(n):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({w for places in seen.values() if len(places) > 1 for i in places for w in range(i, i + 8)})


def brute(text):
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.encode().split()]
    return {
        "n_words": len(words), "word_chars": sum(len(w.decode()) for w in words), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": brute_repeats(words),
        "base_failed": len(words) < 20 or 100 * brute_repeats(words) > 30 * len(words),
    }


@pytest.mark.parametrize("seed", range(30))
def test_repeated_words(seed):
    rng = random.Random(seed)
    words = [rng.choice([b"a", b"b", b"c"][: 1 + seed % 3]) for _ in range(rng.randint(0, 60))]
    assert quality.repeated_words(words) == brute_repeats(words)


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(40):
        scores, t = rng.normal(size=(rng.integers(1, 9), 2)), rng.normal(size=(2, 2))
        total = lambda p: sum(scores[i, k] for i, k in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:]))
        best = max(total([k >> i & 1 for i in range(len(scores))]) for k in range(1 << len(scores)))
        assert total(quality.viterbi(scores, t).tolist()) == pytest.approx(best)


def test_measures_match_brute_force(spark):
    got = quality.assess(documents(spark).select("doc_id", "text"), None).collect()
    want = {(i, t): brute(t) for i, t, *_ in rows()}
    assert len(got) == len(rows())
    for r in got:
        expected = want[r.doc_id, r.text]
        assert {k: r[k] for k in expected} == expected
        assert r.kept == (not r.base_failed)  # without a model every line is content


def test_verdicts_on_held_out_labels(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    held = labels.filter(F.xxhash64("doc_id", F.lit(1)) % 2 == 0)
    model = quality.fit_model(docs, labels.join(held, "doc_id", "left_anti"))
    judged = quality.assess(docs.select("doc_id", "text"), model).join(held, "doc_id").filter("not base_failed").collect()
    good, bad = [r.kept for r in judged if r.quality == 1], [r.kept for r in judged if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and len(good) > 50
    # Lines of one text part ways: prose above and below a block of shouts and marks, as much and more of it.
    clean = [r.text for r in docs.join(held, "doc_id").filter("quality = 1 and toxic = 0").orderBy("doc_id").limit(40).collect()]
    junk = ["BUY NOW!! BEST PRICE!! CLICK HERE!!", "a### b$$$ c%%% d&&& e### f$$$ g%%%"] * 6
    apart = 0
    for text in clean:
        prose_lines = [x for x in text.split("\n") if len(x.split()) >= 5 and x.upper() != x and not set(x) & set("|#$%&*!<>")]
        lines = prose_lines + [f"{x} {k}" for k, x in enumerate(junk)] + prose_lines[::-1]
        x, sizes = quality.line_features("\n".join(lines))
        marks = quality.viterbi(x @ model[0], model[1])
        inside, n = marks[len(prose_lines) : len(prose_lines) + len(junk)], len(prose_lines)
        apart += n > 1 and not inside.any() and marks[:n].mean() >= 0.9
        # Without a change of label at such a block, the text would be of one label.
    assert apart >= 0.8 * sum(len([x for x in t.split("\n") if len(x.split()) >= 5]) > 1 for t in clean)
    assert sum(bad) <= 0.2 * len(bad) and len(bad) > 5


def test_line_labels():
    usual = np.tile([1.0, 0.4, 0, 0.1, 0, 0, 0, 1, 0.9, 0, 0], (50, 1))
    marked, again = usual.copy(), usual.copy()
    marked[7, 2], again[9, 5] = 0.9, 1.0  # a line of symbols, a repeated line
    shouting, whole = usual[:10].copy(), usual[:10].copy()
    shouting[4:, 6] = 1.0
    table = usual[:8].copy()
    table[:4, 2] = 0.9  # a good text with many such lines
    # Of 708 good lines five are of symbols, fewer than the share that counts as usual.
    got = quality.line_labels([marked, again, table, *[usual] * 12, shouting, whole], [1] * 15 + [0, 0])
    assert np.flatnonzero(got[0] == 0).tolist() == [7] and np.flatnonzero(got[1] == 0).tolist() == [9]
    assert all(x.all() for x in got[2:15])
    assert got[15].tolist() == [1] * 4 + [0] * 6 and not got[16].any()


def test_sampled_lines_span_the_text():
    lines = np.arange(1000.0)[:, None]
    got = quality.spread(lines, 60).ravel()
    assert len(got) == 60 and got[0] == 0 and got[-1] == 999 and got[20] > 300
    assert quality.spread(lines[:60], 60).shape == (60, 1)


def test_fit_is_repeatable(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    a, b = quality.fit_model(docs, labels), quality.fit_model(docs.repartition(5), labels.repartition(3))
    assert all(np.array_equal(x, y) for x, y in zip(a, b))


def test_keep_good_returns_the_columns_of_its_input(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(5, 1, 0), (13, 0, 0), (None, 1, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert all(r.n_words == 9 and r.name == "x" for r in kept.collect())


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.keep_good(empty(spark), none).count() == 0
    assert quality.fit_model(documents(spark), none) is None
    assert len(prose(3, 1).split()) == 3
