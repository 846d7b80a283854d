from __future__ import annotations

import random
import re

import numpy as np
import pytest

from glyco.llm import pii
from tests.llm.fixtures import documents, empty, rows

PIECES = ["a", "@", ".", "-", "1", "23", "456", "255", "7890", "+1 ", "(", "555) ", "4111111111111111", " ", "x.y", "ü", "b@c.d", "1.2.3.4", ".5"]


def brute(text):
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), m.end(), 2))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_fixed_rules_match_the_expressions():
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 12)))
        assert pii.base_spans(text) == brute(text), text
    assert len(pii.base_spans("9" * 1_000_000 + "a" * 1_000_000)) == 0


def test_gradients():
    rng = np.random.default_rng(0)
    model = pii.Tagger.fresh(1)
    model.p["step"] = rng.normal(0, 0.3, model.p["step"].shape)
    codes, labels = rng.integers(0, pii.SYMBOLS, (6, 3)), rng.integers(0, pii.LABELS, (6, 3))

    def likelihood():
        s, step = model.scores(codes), model.p["step"]
        ahead = s[0]
        for t in range(1, len(s)):
            ahead = pii._logsum(ahead[:, :, None] + step, 1) + s[t]
        given = np.take_along_axis(s, labels[:, :, None], 2).sum((0, 2)) + step[labels[:-1], labels[1:]].sum(0)
        return (given - pii._logsum(ahead, 1)).mean()

    found = model.gradients(codes, labels)
    for name, value in model.p.items():
        at = (int(codes[2, 1]), 3) if name == "embed" else tuple(int(rng.integers(0, n)) for n in value.shape)
        old, e = value[at], 1e-5
        value[at] = old + e
        up = likelihood()
        value[at] = old - e
        down = likelihood()
        value[at] = old
        assert found[name][at] == pytest.approx((up - down) / (2 * e), abs=1e-6)


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_held_out_accuracy(model):
    windows, spans = pii.labelled([], [], seed=99, more=600)
    right = wrong = missed = 0
    for want, got in zip(spans, pii.tagged(model, windows)):
        whole = {s for s in want if s[1] < pii.WINDOW}
        right += len(whole & set(got))
        missed += len(whole - set(got))
        wrong += len([s for s in got if s[1] < pii.WINDOW and s not in whole])
    assert right / (right + missed) >= 0.8 and right / (right + wrong) >= 0.9


def test_windows_agree_across_their_edges(model):
    value = "john.smith@example.com"
    for at in range(0, 3 * pii.WINDOW, 7):
        text = "the river runs and the fox jumps over it again " * 8
        text = text[:at] + " " + value + " " + text[at:]
        base, every = pii.find(model, [text])[0]
        assert every == base == [(at + 1, at + 1 + len(value), 0)]


def test_scan_keeps_base_spans(spark, model):
    got = pii.scan(documents(spark), model).collect()
    assert len(got) == len(rows())
    texts = [(1, "Mail a.b@c.org or call +1 (555) 555-0199, ssn 123-45-6789."), (2, "clean text about nothing"), (3, "9.9.9.9 " * 3000), (4, None)]
    got = {r.doc_id: r for r in pii.scan(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert (got[1].n_email, got[1].n_phone) == (1, 1) and got[1].spans.startswith("email:5:14,phone:23:40")
    assert got[2].spans == "" and got[4].spans == ""
    assert got[3].n_ip == 3000
    assert pii.scan(empty(spark), model).count() == 0


def test_fit_on_an_empty_table_still_learns(spark):
    windows, spans = pii.training_windows(empty(spark))
    assert len(windows) == len(spans) == 1000
