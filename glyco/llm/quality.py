"""Quality rules, and line labels by a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyco.llm.ranks import sample_candidates

WINDOW = 8  # words of a repeated window
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of words in repeated windows
SAMPLE_DOCS = 300  # labelled documents of each class that the model is fitted on
SAMPLE_LINES = 60  # lines of such a document, spread evenly over the whole text
USUAL = 0.99  # share of the good documents' lines that a usual line's feature does not exceed
FLAGGED = (2, 3, 5, 6)  # features that speak against a line: symbols, capitals, repeated, shouts
CONTENT_SHARE = 0.5
SEED = 42
SYMBOLS = b"#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
CONTENT = 1  # label of a content line; 0 is boilerplate

FEATURES = 11


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    # Equal windows have equal hashes: without equal hashes nothing repeats.
    each = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + each[k : k + n]
    ordered = np.sort(mixed)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    # Exact: names of single words, then of neighbouring pairs, quadruples, ...
    number: dict[bytes, int] = {}
    names = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    span = 1
    while span < window:
        step = min(span, window - span)
        names = np.unique(names[: len(names) - step] * (len(words) + 1) + names[step:], return_inverse=True)[1].reshape(-1)
        span += step
    twice = np.bincount(names)[names] > 1
    marks = np.zeros(len(words) + 1, np.int64)
    marks[:-window] += twice
    marks[window:] -= twice
    return int((np.cumsum(marks)[:-1] > 0).sum())


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line with a word, and the lines' words."""
    rows, sizes, seen = [], [], set()
    for line in text.split("\n"):
        body = line.encode()
        words = body.split()
        if not words:
            continue
        n, letters = len(line), sum(map(str.isalpha, line)) if not line.isascii() else _ascii_letters(body)
        upper = len(body) - len(body.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        marks = len(body) - len(body.translate(None, SYMBOLS))
        digits = len(body) - len(body.translate(None, b"0123456789"))
        shouts = body.count(b"!")
        rows.append(
            (
                1.0,
                min(np.log1p(len(words)), 6.0) / 6,
                min(marks / len(words), 1.0),
                min(upper / max(1, letters), 1.0),
                min(digits / n * 5, 1.0),
                float(line in seen),
                min(shouts / len(words), 1.0),
                float(body.rstrip()[-1:] in b".?!"),
                min(letters / n, 1.0),
                1 - len(set(words)) / len(words),
                float(len(words) < 3),
            )
        )
        sizes.append(len(words))
        seen.add(line)
    return np.array(rows).reshape(-1, FEATURES), np.array(sizes, dtype=np.int64)


def _ascii_letters(body: bytes) -> int:
    return len(body) - len(body.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))


def viterbi(scores: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The best label of each line; ``scores`` is lines x 2."""
    n, back = len(scores), np.zeros((len(scores), 2), np.int8)
    t = transitions.tolist()
    zero, one = scores[0].tolist()
    for k, (x, y) in enumerate(scores[1:].tolist(), 1):
        to_zero, to_one = (zero + t[0][0], one + t[1][0]), (zero + t[0][1], one + t[1][1])
        back[k] = to_zero[1] > to_zero[0], to_one[1] > to_one[0]
        zero, one = max(to_zero) + x, max(to_one) + y
    labels = np.zeros(n, np.int8)
    labels[-1] = one > zero
    for k in range(n - 1, 0, -1):
        labels[k - 1] = back[k, labels[k]]
    return labels


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def line_labels(sequences: list[np.ndarray], labels: list[int]) -> list[np.ndarray]:
    """A label for each line: content, unless it repeats in its text or a feature against it is unusual.

    Unusual is what exceeds the ``USUAL`` share of the lines of good documents. A bad document without any such
    line is bad as a whole, so all its lines are boilerplate; a good one in which they are a quarter or more is
    good as a whole, as tables and code are.
    """
    good = np.concatenate([s for s, k in zip(sequences, labels) if k == CONTENT])[:, FLAGGED]
    most = np.quantile(good, USUAL, axis=0)
    told = []
    for s, k in zip(sequences, labels):
        odd = (s[:, FLAGGED] > most).any(axis=1) | (s[:, 5] > 0)
        mixed = odd.any() if k != CONTENT else 4 * odd.sum() < len(s)
        told.append(np.where(odd, 0, CONTENT) if mixed else np.full(len(s), k))
    return told


def fit_crf(sequences: list[np.ndarray], labels: list[np.ndarray], classes: list[int], steps: int = 250, rate: float = 0.1, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x 2) and transitions (2 x 2) of greatest likelihood, by Adam.

    ``labels`` holds one label a line. All documents advance together, one line a step, through the forward
    and backward recursions; the documents of both ``classes`` weigh the same.
    """
    longest, docs = max(map(len, sequences)), len(sequences)
    x, real = np.zeros((docs, longest, FEATURES)), np.zeros((docs, longest), bool)
    for d, s in enumerate(sequences):
        x[d, : len(s)], real[d, : len(s)] = s, True
    y = np.array(classes)
    share = np.array([1 / max(1, (y == k).sum()) for k in (0, 1)])[y]
    told, seen = np.zeros((docs, longest, 2)), np.zeros((2, 2))
    for d, line in enumerate(labels):
        told[d, np.arange(len(line)), line] = 1.0
        np.add.at(seen, (line[:-1], line[1:]), share[d])
    params = np.zeros(FEATURES * 2 + 4)
    first, second = np.zeros_like(params), np.zeros_like(params)
    last = real.sum(axis=1) - 1
    inner = real[:, 1:]
    for step in range(1, steps + 1):
        w, t = params[:-4].reshape(FEATURES, 2), params[-4:].reshape(2, 2)
        s = x @ w
        ahead, behind = np.zeros((docs, longest, 2)), np.zeros((docs, longest, 2))
        ahead[:, 0] = s[:, 0]
        for k in range(1, longest):
            ahead[:, k] = s[:, k] + _logsum(ahead[:, k - 1, :, None] + t, 1)
        for k in range(longest - 2, -1, -1):
            onward = _logsum(t + (s[:, k + 1] + behind[:, k + 1])[:, None, :], 2)
            behind[:, k] = np.where(real[:, k + 1, None], onward, 0.0)
        norm = _logsum(ahead[np.arange(docs), last], 1)
        at = np.exp(ahead + behind - norm[:, None, None]) * real[:, :, None]
        pair = np.exp(ahead[:, :-1, :, None] + t + (s + behind)[:, 1:, None, :] - norm[:, None, None, None]) * inner[:, :, None, None]
        grad_w = np.einsum("d,dlf,dlk->fk", share, x, told - at)
        grad_t = seen - np.einsum("d,dlij->ij", share, pair)
        grad = np.concatenate((grad_w.ravel(), grad_t.ravel())) - penalty * params
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        params += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return params[:-4].reshape(FEATURES, 2), params[-4:].reshape(2, 2)


def fit_model(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, np.ndarray] | None:
    """A field fitted on ``sample_docs`` labelled documents of each class, the same ones each time.

    None when a class has no labelled document with a word; every line then counts as content.
    """
    chosen: dict[int, int] = {}
    for quality in (0, 1):
        of_class = labels.filter((F.col("quality") == quality) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
        lowest = sample_candidates(of_class, ["doc_id"], sample_docs, SEED).orderBy("place", "doc_id").limit(sample_docs)
        for doc_id, _ in lowest.collect():
            chosen.setdefault(doc_id, quality)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spread(line_features(t or "")[0]).ravel().tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "lines"])

    if len(set(chosen.values())) < 2:
        return None
    sample = docs.filter(F.col("doc_id").isin(list(chosen))).select(F.col("doc_id").cast("long"), "text").mapInArrow(lines, "doc_id long, lines array<double>")
    # At most 2 * sample_docs documents, each once.
    rows = sorted((r.doc_id, tuple(r.lines)) for r in sample.groupBy("doc_id").agg(F.min("lines").alias("lines")).collect() if r.lines)
    answers = [chosen[d] for d, _ in rows]
    if len(set(answers)) < 2:
        return None
    sequences = [np.array(x).reshape(-1, FEATURES) for _, x in rows]
    return fit_crf(sequences, line_labels(sequences, answers), answers)


def spread(lines: np.ndarray, most: int = SAMPLE_LINES) -> np.ndarray:
    """At most ``most`` lines of a text: runs of neighbouring lines, evenly spread from the first to the last."""
    if len(lines) <= most:
        return lines
    run = 20
    firsts = np.linspace(0, len(lines) - run, most // run).astype(int)
    return lines[np.unique((firsts[:, None] + np.arange(run)).ravel())]


def assess(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, content_share: float = CONTENT_SHARE) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_content_words, base_failed, kept.

    Words are runs of non-white-space. ``base_failed``: fewer than 20 words, or more than 30 % of them in
    repeated 8-word windows. Viterbi decoding marks each line with a word as content or boilerplate; a
    document is kept if it has not failed and at least ``content_share`` of its words are content. Null
    and empty texts have no words and fail. Each row stands alone, so repeated rows get equal answers;
    an empty table gives no rows. Columns of ``docs`` with a name that is added here are replaced.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_content_words"]

    def measure(text: str | None) -> list[int]:
        text = text or ""
        body = text.encode()
        words = body.split()
        white = sum(map(text.count, SPACES))
        seen: set[str] = set()
        repeats = 0
        for line in text.split("\n"):
            if line.encode().split():
                repeats += line in seen
                seen.add(line)
        content = len(words)
        if words and model:
            x, sizes = line_features(text)
            content = int(sizes[viterbi(x @ model[0], model[1]) == CONTENT].sum())
        return [len(words), len(text) - white, len(body) - len(body.translate(None, SYMBOLS)), repeats, repeated_words(words), content]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            found = np.array([measure(t) for t in batch.column(at).to_pylist()], dtype=np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c) for c in found.T]], names=[*batch.schema.names, *names])

    added = {*names, "base_failed", "kept"} - {"text"}
    rest = docs.drop(*[c for c in docs.columns if c in added])
    schema = T.StructType([*rest.schema.fields, *[T.StructField(name, T.LongType()) for name in names]])
    out = rest.mapInArrow(run, schema)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_content_words") >= content_share * F.col("n_words")))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    own = [c if c == "text" else f"_{i}" for i, c in enumerate(docs.columns)]  # clashes with no added column
    judged = assess(docs.toDF(*own), fit_model(docs, labels)).filter("kept")
    return judged.select(*[F.col(o).alias(c) for o, c in zip(own, docs.columns)])
