"""Personal data: fixed rules, and a character-level bidirectional LSTM with CRF transitions in numpy."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyco.llm.ranks import sample_candidates

# Kinds in listing order: those of the fixed rules, then the model's own.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "iban", "date")
TRIGGER = re.compile("[0-9@]")  # every span holds one of these characters
WINDOW, STRIDE = 96, 48  # characters
SAMPLE_DOCS = 200  # documents that training windows come from
SAMPLE_WINDOWS = 4  # of each such document
HIDDEN, EMBEDDED = 16, 12
STEPS, BATCH, RATE = 600, 32, 0.02
AREA = 4096  # characters of one Viterbi path
HELD = 1 << 17  # characters scored before their scores are released
SURE = 0.8  # least mean probability of a span's labels
SEED = 42

# --- fixed rules ------------------------------------------------------------------------------------

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the fixed rules, leftmost and without overlap per kind, in linear time."""
    out = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            out.append((start, match.end(), 0))
            free = match.end()
        at = text.find("@", at + 1)
    for run in DOTTED.finditer(text):
        parts, start = run[0].split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                out.append((start, end, 1))
            start = end + 1
    for run in DIGITS.finditer(text):
        digits = run[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((run.start(), run.end(), 2))
    for run in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in run[0]) <= 15:
            out.append((run.start(), run.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


# --- the model --------------------------------------------------------------------------------------

LABELS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
PRINTABLE = 95
SYMBOLS = PRINTABLE + 3  # printable ASCII, other white space, other letters, the rest


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    rest = np.where(points < 32, PRINTABLE, np.where(points < 127, points - 32, PRINTABLE + 1))
    return np.where((points >= 0x2000) | ((points >= 127) & (points < 0xC0)), PRINTABLE + 2, rest)


def label(spans: list[tuple[int, int, int]], length: int) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for start, end, kind in spans:
        if not out[start:end].any():
            out[start:end] = 2 + 2 * kind
            out[start] = 1 + 2 * kind
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass
class Tagger:
    """Parameters by name; one LSTM reads forward, one backward, a linear layer scores the labels."""

    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = SEED) -> Tagger:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
        p = {"embed": rng.normal(0, 0.3, (SYMBOLS, EMBEDDED)), "out": draw(2 * HIDDEN, LABELS), "bias": np.zeros(LABELS), "step": np.zeros((LABELS, LABELS))}
        for side in ("f", "b"):
            p |= {f"x{side}": draw(EMBEDDED, 4 * HIDDEN), f"h{side}": draw(HIDDEN, 4 * HIDDEN), f"c{side}": np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)))}
        return cls(p)

    def _read(self, x: np.ndarray, side: str, keep: bool):
        """Hidden states of one direction over (time, batch, embedded)."""
        steps, batch = x.shape[:2]
        order = range(steps) if side == "f" else range(steps - 1, -1, -1)
        given = x @ self.p[f"x{side}"] + self.p[f"c{side}"]
        h, c = np.zeros((batch, HIDDEN), x.dtype), np.zeros((batch, HIDDEN), x.dtype)
        hidden, trace = np.zeros((steps, batch, HIDDEN), x.dtype), []
        for t in order:
            z = given[t] + h @ self.p[f"h{side}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            before, last = c, h
            c = f * c + i * g
            squashed = np.tanh(c)
            h = o * squashed
            hidden[t] = h
            if keep:
                trace.append((t, i, f, o, g, before, squashed, last))
        return hidden, trace

    def scores(self, codes: np.ndarray, keep: bool = False):
        """Label scores (time, batch, labels) of codes (time, batch)."""
        x = self.p["embed"][codes]
        (ahead, first), (behind, second) = self._read(x, "f", keep), self._read(x, "b", keep)
        both = np.concatenate((ahead, behind), axis=2)
        out = both @ self.p["out"] + self.p["bias"]
        return (out, x, both, first, second) if keep else out

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log-likelihood of the label sequences under the CRF."""
        s, x, both, first, second = self.scores(codes, keep=True)
        steps, batch = codes.shape
        at, pair = marginals(s, self.p["step"])
        told = np.zeros_like(s)
        np.put_along_axis(told, labels[:, :, None], 1.0, axis=2)
        seen = np.zeros_like(self.p["step"])
        np.add.at(seen, (labels[:-1].ravel(), labels[1:].ravel()), 1.0)
        ds = (told - at) / batch
        g = {"step": (seen - pair) / batch, "out": np.einsum("tbh,tbk->hk", both, ds), "bias": ds.sum(axis=(0, 1))}
        dboth = ds @ self.p["out"].T
        dx = np.zeros_like(x)
        for side, trace, dh in (("f", first, dboth[:, :, :HIDDEN]), ("b", second, dboth[:, :, HIDDEN:])):
            dz_all, dlast, dc = np.zeros((steps, batch, 4 * HIDDEN)), np.zeros((batch, HIDDEN)), np.zeros((batch, HIDDEN))
            gh = np.zeros_like(self.p[f"h{side}"])
            for t, i, f, o, new, before, squashed, last in reversed(trace):
                d = dh[t] + dlast
                dc = dc + d * o * (1 - squashed**2)
                dz = np.concatenate((dc * new * i * (1 - i), dc * before * f * (1 - f), d * squashed * o * (1 - o), dc * i * (1 - new**2)), axis=1)
                dz_all[t] = dz
                gh += last.T @ dz
                dlast, dc = dz @ self.p[f"h{side}"].T, dc * f
            g |= {f"h{side}": gh, f"c{side}": dz_all.sum(axis=(0, 1)), f"x{side}": np.einsum("tbe,tbz->ez", x, dz_all)}
            dx += dz_all @ self.p[f"x{side}"].T
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], codes, dx)
        return g


def marginals(s: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities (time, batch, labels), and expected transitions summed over all."""
    ahead, behind = np.zeros_like(s), np.zeros_like(s)
    # Probabilities are scaled at every step instead of summed in logarithms.
    moves = np.exp(step)
    e = np.exp(s - s.max(axis=2, keepdims=True))
    ahead[0] = e[0] / e[0].sum(axis=1, keepdims=True)
    for t in range(1, len(s)):
        a = (ahead[t - 1] @ moves) * e[t]
        ahead[t] = a / a.sum(axis=1, keepdims=True)
    behind[-1] = 1.0
    for t in range(len(s) - 2, -1, -1):
        b = (behind[t + 1] * e[t + 1]) @ moves.T
        behind[t] = b / b.sum(axis=1, keepdims=True)
    at = ahead * behind
    at /= at.sum(axis=2, keepdims=True)
    left, right = ahead[:-1], behind[1:] * e[1:]
    norm = np.einsum("tbi,ij,tbj->tb", left, moves, right)
    return at, np.einsum("tbi,tbj->ij", left / norm[:, :, None], right) * moves


def train(windows: list[str], spans: list[list[tuple[int, int, int]]], steps: int = STEPS, seed: int = SEED) -> Tagger:
    """A tagger of greatest likelihood by Adam; windows are padded with spaces to ``WINDOW``."""
    model, rng = Tagger.fresh(seed), np.random.default_rng(seed)
    codes = np.array([encode(w[:WINDOW].ljust(WINDOW)) for w in windows]).T
    labels = np.array([label(s, WINDOW) for s in spans]).T
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    order = np.zeros(0, np.int64)
    for n in range(1, steps + 1):
        if len(order) < BATCH:
            order = np.concatenate((order, rng.permutation(codes.shape[1])))
        chosen, order = order[:BATCH], order[BATCH:]
        rate = RATE * (1 - 0.95 * n / steps)
        for k, g in model.gradients(codes[:, chosen], labels[:, chosen]).items():
            g = np.clip(g, -1, 1)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            model.p[k] += rate * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-8)
    return model


# --- labelled spans ---------------------------------------------------------------------------------


def made_up(kind: str, rng: random.Random) -> str:
    """An invented value of a kind, in the forms that the rules and the model shall know."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))
    if kind == "email":
        return f"{word()}{rng.choice(['', '.', '_', '.' + digits(2)])}{word()}@{word()}{rng.choice(['.com', '.org', '.example.com', '.de'])}"
    if kind == "ip":
        return ".".join(str(rng.randint(1, 255)) for _ in range(4))
    if kind == "card":
        body = digits(15)
        number = next(body + d for d in "0123456789" if luhn(body + d))
        sep = rng.choice(["", "", " ", "-"])
        return sep.join(number[i : i + 4] for i in range(0, 16, 4))
    if kind == "phone":
        return rng.choice(["+1 ({a}) {b}-{c}", "+{a} {b} {c}", "({a}) {b}-{c}", "+1-{a}-{b}-{c}"]).format(a=digits(3), b=digits(3), c=digits(4))
    if kind == "ssn":
        return f"{digits(3)}-{digits(2)}-{digits(4)}"
    if kind == "iban":
        return rng.choice(["DE", "FR", "GB", "ES"]) + digits(2) + rng.choice(["", " "]).join(digits(4) for _ in range(rng.randint(4, 5)))
    return rng.choice([f"{rng.randint(1920, 2015)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{rng.randint(1, 28):02}/{rng.randint(1, 12):02}/{rng.randint(1920, 2015)}"])


def noise(rng: random.Random) -> str:
    """Text with digits that names nobody."""
    hexed = "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(8, 40)))
    return rng.choice([str(rng.randint(0, 9999)), f"Version {rng.randint(1, 9)}.{rng.randint(0, 9)}", f'token = "{hexed}"', hexed, f"{rng.randint(1, 99)}%", f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", f"{rng.random() * 1000:.2f}", f"@{hexed[:6]}", str(rng.randint(10**5, 10**11))])


def labelled(plain: list[str], found: list[tuple[str, list[tuple[int, int, int]]]], seed: int = SEED, more: int = 1000) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """Training windows: those of the corpus, and ``more`` with an invented value or noise set into plain text."""
    rng = random.Random(seed)
    filler = [*plain, "The quick brown fox, jumps over the lazy dog. " * 3]
    windows, spans = [w for w, _ in found], [s for _, s in found]
    for k in range(more):
        body, at = rng.choice(filler)[:WINDOW], rng.randint(0, 45)
        kind = KINDS[k % len(KINDS)] if k % 3 else None
        value = made_up(kind, rng) if kind else noise(rng)
        head, tail = body[:at], body[at:]
        head += rng.choice([" ", " ", ": ", "(", "\n"]) if head else ""
        text = head + value + rng.choice([" ", " ", ", ", ".\n", ") ", "; "]) + tail
        window = text[:WINDOW]
        windows.append(window)
        end = len(head) + len(value)
        spans.append([(len(head), end, KINDS.index(kind))] if kind and end <= WINDOW else label_cut(kind, len(head), end))
    return windows, spans


def label_cut(kind: str | None, start: int, end: int) -> list[tuple[int, int, int]]:
    """A value that the window's edge cuts keeps its label up to there."""
    return [(start, min(end, WINDOW), KINDS.index(kind))] if kind and start < WINDOW else []


def training_windows(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], list]:
    """Windows around the fixed rules' spans in ``sample_docs`` documents that hold a digit or @, the same ones each time."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                hits = [m.start() for m in TRIGGER.finditer(text)]
                picks = sorted({hits[i * len(hits) // SAMPLE_WINDOWS] for i in range(SAMPLE_WINDOWS)})
                rows.append([text[max(0, p - 30) : max(0, p - 30) + WINDOW] for p in picks] + [text[:WINDOW]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.string()))], names=["place", "windows"])

    holding = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull())
    near = sample_candidates(holding, ["doc_id", "text"], sample_docs, SEED).select("place", "text")
    chosen = near.mapInArrow(cut, "place long, windows array<string>").orderBy("place", "windows").limit(sample_docs)
    found, plain = [], []
    for _, windows in chosen.collect():
        found += [(w, base_spans(w)) for w in windows[:-1]]
        plain += [w for w in windows[-1:] if not TRIGGER.search(w)]
    return labelled(plain, found)


# --- decoding ---------------------------------------------------------------------------------------


def regions(text: str) -> list[tuple[int, int]]:
    """Runs of whole strides in which some window holds a trigger; a window is two strides."""
    marks = np.zeros(len(text) // STRIDE + 3, bool)
    for m in TRIGGER.finditer(text):
        k = m.start() // STRIDE
        marks[max(0, k - 1) : k + 2] = True
    edges = np.flatnonzero(np.diff(np.concatenate(([False], marks, [False])).astype(np.int8)))
    return [(int(a) * STRIDE, min(len(text), int(b) * STRIDE)) for a, b in zip(edges[::2], edges[1::2]) if int(a) * STRIDE < len(text)]


def tagged(model: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """The model's spans in each text.

    Windows are scored in batches. Where windows overlap their scores are averaged, weighted by the
    distance to the window's edge; one Viterbi path then runs through each whole region, so overlapping
    windows cannot disagree. Regions beyond ``AREA`` characters are read in pieces that overlap by a window
    on either side; a piece gives the spans that begin inside it. A span stays if its labels have a mean
    probability of at least ``SURE`` and it holds a digit or @.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    held, size = [], 0
    for k, text in enumerate(texts):
        for a, b in regions(text):
            for start in range(a, b, AREA):
                stop = min(b, start + AREA)
                held.append((k, max(a, start - WINDOW), min(b, stop + WINDOW), start, stop))
                size += stop - start
                if size >= HELD:
                    _tag_areas(model, texts, held, out)
                    held, size = [], 0
    _tag_areas(model, texts, held, out)
    return [_apart(spans) for spans in out]


def _apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of overlapping spans the first."""
    out: list[tuple[int, int, int]] = []
    for s in sorted(spans):
        if not out or out[-1][1] <= s[0]:
            out.append(s)
    return out


def _tag_areas(model: Tagger, texts: list[str], areas: list[tuple[int, int, int, int, int]], out: list[list]) -> None:
    starts = [(n, at) for n, (_, a, b, *_) in enumerate(areas) for at in range(a, max(a + 1, b - STRIDE), STRIDE)]
    near = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float64)
    sums = [np.zeros((b - a, LABELS)) for _, a, b, *_ in areas]
    weights = [np.zeros(b - a) for _, a, b, *_ in areas]
    for first in range(0, len(starts), 512):
        part = starts[first : first + 512]
        cut = [texts[areas[n][0]][at : min(at + WINDOW, areas[n][2])] for n, at in part]
        scored = model.scores(np.array([encode(w.ljust(WINDOW)) for w in cut]).T)
        for j, ((n, at), w) in enumerate(zip(part, cut)):
            lo = at - areas[n][1]
            sums[n][lo : lo + len(w)] += scored[: len(w), j] * near[: len(w), None]
            weights[n][lo : lo + len(w)] += near[: len(w)]
    order = sorted(range(len(areas)), key=lambda n: len(sums[n]))
    for first in range(0, len(order), 64):
        group = order[first : first + 64]
        longest = len(sums[group[-1]])
        s = np.zeros((longest, len(group), LABELS))
        for j, n in enumerate(group):
            s[: len(sums[n]), j] = sums[n] / weights[n][:, None]
            s[len(sums[n]) :, j, 1:] = -50.0  # after its end a region is outside
        path, sure = decode(s, model.p["step"])
        for j, n in enumerate(group):
            k, a, b, own, stop = areas[n]
            for start, end, kind in spans_of(path[: b - a, j]):
                if own <= a + start < stop and sure[start:end, j].mean() >= SURE and TRIGGER.search(texts[k], a + start, a + end):
                    out[k].append((a + start, a + end, kind))


def decode(s: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best label path of each column, and the probability of each of its labels."""
    best, back = s[0], np.zeros(s.shape, np.int16)
    for t in range(1, len(s)):
        total = best[:, :, None] + step
        back[t] = total.argmax(axis=1)
        best = np.take_along_axis(total, back[t][:, None, :].astype(np.int64), axis=1)[:, 0] + s[t]
    path = np.zeros(s.shape[:2], np.int64)
    path[-1] = best.argmax(axis=1)
    for t in range(len(s) - 1, 0, -1):
        path[t - 1] = back[t][np.arange(s.shape[1]), path[t]]
    at, _ = marginals(s, step)
    return path, np.take_along_axis(at, path[:, :, None], axis=2)[:, :, 0]


def spans_of(path: np.ndarray) -> list[tuple[int, int, int]]:
    out, t = [], 0
    labels = path.tolist()
    while t < len(labels):
        if labels[t] == 0:
            t += 1
            continue
        kind, start = (labels[t] - 1) // 2, t
        t += 1
        while t < len(labels) and labels[t] == 2 + 2 * kind:
            t += 1
        out.append((start, t, kind))
    return out


def find(model: Tagger, texts: list[str]) -> list[tuple[list, list]]:
    """(fixed-rule spans, all spans) of each text: a model span is added where it overlaps no fixed-rule span."""
    out = []
    own = [base_spans(t) if TRIGGER.search(t) else [] for t in texts]
    for base, added in zip(own, tagged(model, texts)):
        free = [s for s in added if all(s[1] <= b[0] or b[1] <= s[0] for b in base)]
        out.append((base, sorted(base + free, key=lambda s: (s[0], s[2]))))
    return out


def scan(docs: DataFrame, model: Tagger) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and ``base_sha256`` cover the fixed rules; ``spans`` lists theirs and the model's as
    kind:start:end in code points by start, then kind. Windows without a digit or @ need no reading, since
    no span is without one. Null and empty texts have no spans; repeated rows get equal answers; an empty
    table gives no rows; other columns are ignored.
    """
    params = {k: v.astype(np.float32) for k, v in model.p.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(params)
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for base, every in find(tagger, texts):
                listed = [",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in x) for x in (base, every)]
                counts = [sum(k == n for _, _, k in base) for n in range(len(BASE_KINDS))]
                rows.append((*counts, hashlib.sha256(listed[0].encode()).hexdigest(), listed[1]))
            columns = [list(c) for c in zip(*rows)] or [[] for _ in range(6)]
            arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(c, pa.string()) for c in columns[4:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans"])

    fields = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, fields)


def fit(docs: DataFrame) -> Tagger:
    return train(*training_windows(docs))
