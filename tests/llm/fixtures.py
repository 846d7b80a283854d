"""Small tables with every awkward row the operators must take."""

from __future__ import annotations

import random

COLUMNS = "doc_id long, text string, source string, lang string, n_chars long, size long, rank long, kept boolean, name string, n_words long"
PROSE = "the quick brown fox jumps over the lazy dog while the river runs down to the sea and nobody minds the rain at all today".split()


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(PROSE) + str(rng.randint(0, 99)) if i % 3 else rng.choice(PROSE) for i in range(n))


def rows() -> list[tuple]:
    long_text = "\n".join(prose(60, 1000 + k) for k in range(400))
    passage = prose(60, 5)
    texts = [
        (1, None, "a"),
        (2, "", "a"),
        (3, " \t\r\n\x0b\x0c ", None),
        (4, "Straße Ünïcode 汉字 😀 word", None),
        (5, prose(120, 1), "b"),
        (6, prose(120, 1).upper(), "b"),
        (7, prose(120, 1).replace("river", "stream"), "c"),
        (8, long_text, "c"),
        (9, long_text, "a"),
        (10, prose(30, 2) + "\n" + passage + "\n" + prose(30, 3), "b"),
        (11, prose(45, 4) + "\n" + passage, "d"),
        (12, "Ä" * 5000, "d"),
        (13, "same line here\nsame line here\nsame line here\n" * 20, "e"),
        (14, "tie", "e"),
        (15, "tie", "e"),
        (16, "0" * 3000, "e"),
        (None, "no id at all but some words", "f"),
        (18, prose(40, 6), "hot"),
        (18, prose(40, 6), "hot"),
        (19, "one", "hot"),
        *[(100 + k, prose(25, 50), "hot") for k in range(40)],
        *[(200 + k, prose(10 + k, 60 + k), "hot") for k in range(40)],
    ]
    return [(i, t, s, "en", 0, 7, 7, None, "x", 9) for i, t, s in texts]


def documents(spark):
    return spark.createDataFrame(rows(), COLUMNS)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)
