"""Secret scans by one deterministic automaton for all rules."""

from __future__ import annotations

import hashlib
import re._parser as regex_parser
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A match is ``head``, ``first`` and ``rest`` in turn.

    ``first`` and ``rest`` together need ``least`` bytes and the match ``shortest``. The combined automaton
    searches for ``head`` and ``first`` only, so ``first`` should be short. Letters, classes, groups,
    alternatives and repeats are allowed in patterns; ``fold`` reads letters in either case.
    """

    kind: str
    head: str
    first: str
    rest: str
    least: int = 1
    shortest: int = 1
    fold: bool = False


# The base rules, then the method's own.
BASE = (
    Rule("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", "[A-Za-z0-9+/_.=-]*", least=6, fold=True),
    Rule("access", "AKIA", "[A-Z0-9]", "[A-Z0-9]*", shortest=20),
    Rule("hex", "", "[0-9a-f]{12}", "[0-9a-f]*", shortest=24),
)
RULES = (
    *BASE,
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", "[A-Za-z0-9]*", least=36),
    Rule("gitlab", "glpat-", "[A-Za-z0-9_-]", "[A-Za-z0-9_-]*", least=20),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", "[A-Za-z0-9-]*", least=10),
    Rule("stripe", "[rs]k_(?:live|test)_", "[A-Za-z0-9]", "[A-Za-z0-9]*", least=16),
    Rule("google", "AIza", "[A-Za-z0-9_-]", "[A-Za-z0-9_-]*", least=35),
    Rule("npm", "npm_", "[A-Za-z0-9]", "[A-Za-z0-9]*", least=36),
    Rule("jwt", "eyJ", "[A-Za-z0-9_-]", r"[A-Za-z0-9_-]*\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=30),
    Rule("pem", "-----BEGIN ", "[A-Z]", "[A-Z ]*KEY-----"),
    Rule("login", "[a-z]+://", "[A-Za-z0-9._~%-]", "[A-Za-z0-9._~%-]*:[A-Za-z0-9._~%!-]+@", least=4),
)


class Machine:
    """A non-deterministic automaton over bytes: ``edges[state]`` has (bytes, next), ``jumps`` are free."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.jumps: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.jumps.append([])
        return len(self.edges) - 1

    def add(self, tree, start: int, fold: bool, backward: bool) -> int:
        """The state after a parsed pattern that begins at ``start``."""
        for op, value in reversed(list(tree)) if backward else tree:
            start = self._one(str(op), value, start, fold, backward)
        return start

    def _one(self, op: str, value, start: int, fold: bool, backward: bool) -> int:
        if op in ("LITERAL", "IN"):
            end = self.state()
            self.edges[start].append((_bytes(op, value, fold), end))
            return end
        if op == "SUBPATTERN":
            return self.add(value[3], start, fold, backward)
        if op == "BRANCH":
            end = self.state()
            for branch in value[1]:
                first = self.state()
                self.jumps[start].append(first)
                self.jumps[self.add(branch, first, fold, backward)].append(end)
            return end
        if op == "MAX_REPEAT":
            low, high, inner = value
            for _ in range(low):
                start = self.add(inner, start, fold, backward)
            if high == regex_parser.MAXREPEAT:
                again = self.state()
                self.jumps[start].append(again)
                self.jumps[self.add(inner, again, fold, backward)].append(again)
                return again
            end = self.state()
            self.jumps[start].append(end)
            for _ in range(high - low):
                start = self.add(inner, start, fold, backward)
                self.jumps[start].append(end)
            return end
        raise ValueError(f"{op} is not allowed in a rule")

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.jumps[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


def _bytes(op: str, value, fold: bool) -> frozenset:
    items = [(op, value)] if op == "LITERAL" else [(str(k), v) for k, v in value]
    out: set[int] = set()
    for kind, v in items:
        out |= {v} if kind == "LITERAL" else set(range(v[0], v[1] + 1))
    if fold:
        out |= {ord(chr(b).swapcase()) for b in out if chr(b).isascii() and chr(b).isalpha()}
    return frozenset(out)


@dataclass(frozen=True)
class Automaton:
    """``table[state, class]`` is the next state, ``accepts[state]`` a bit for each rule; state 0 starts, ``dead`` is -1 or the sink."""

    classes: bytes
    table: np.ndarray
    accepts: np.ndarray
    dead: int


def determinise(machine: Machine, starts: list[int], ends: dict[int, int], search: bool) -> Automaton:
    """Subset construction over byte classes, then minimisation. With ``search`` a match may begin anywhere."""
    labels = sorted({x for edges in machine.edges for x, _ in edges}, key=sorted)
    # Bytes that no label tells apart share a class.
    kinds = {b: tuple(b in x for x in labels) for b in range(256)}
    order = {k: i for i, k in enumerate(dict.fromkeys(kinds.values()))}
    classes = bytes(order[kinds[b]] for b in range(256))
    samples = [classes.index(i) for i in range(len(order))]
    first = machine.closure(starts)
    found, table, todo = {first: 0}, [], [first]
    while todo:
        now, row = todo.pop(0), []
        for b in samples:
            step = {t for s in now for x, t in machine.edges[s] if b in x}
            new = machine.closure(step) | first if search else machine.closure(step)
            if new not in found:
                found[new] = len(found)
                todo.append(new)
            row.append(found[new])
        table.append(row)
    accepts = np.array([sum(1 << r for r in {ends[s] for s in states if s in ends}) for states in found], dtype=np.int64)
    return _minimise(classes, np.array(table), accepts, found.get(frozenset(), -1))


def _minimise(classes: bytes, table: np.ndarray, accepts: np.ndarray, dead: int) -> Automaton:
    """Merge states until those of one block agree on the rules they accept and the blocks they lead to."""
    block, count = np.unique(accepts, return_inverse=True)[1].reshape(-1), 0
    while block.max() + 1 != count:
        count = block.max() + 1
        block = np.unique(np.column_stack((block, block[table])), axis=0, return_inverse=True)[1].reshape(-1)
    # Number the blocks so that the start is state 0.
    _, firsts = np.unique(block, return_index=True)
    number = np.empty(count, dtype=np.int64)
    number[block[np.sort(firsts)]] = np.arange(count)
    keep = np.sort(firsts)
    return Automaton(classes, number[block[table[keep]]], accepts[keep], int(number[block[dead]]) if dead >= 0 else -1)


@dataclass(frozen=True)
class Compiled:
    """The combined search automaton; for each rule those of the whole match, of head and first reversed, and of the head."""

    rules: tuple[Rule, ...]
    search: Automaton
    whole: tuple[Automaton, ...]
    reverse: tuple[Automaton, ...]
    heads: tuple[Automaton, ...]


def _single(pattern: str, fold: bool, backward: bool) -> Automaton:
    machine = Machine()
    start = machine.state()
    return determinise(machine, [start], {machine.add(regex_parser.parse(pattern), start, fold, backward): 0}, False)


@cache
def compile_rules(rules: tuple[Rule, ...] = RULES) -> Compiled:
    machine, ends = Machine(), {}
    starts = []
    for number, rule in enumerate(rules):
        starts.append(machine.state())
        ends[machine.add(regex_parser.parse(rule.head + rule.first), starts[-1], rule.fold, False)] = number
    whole = tuple(_single(r.head + r.first + r.rest, r.fold, False) for r in rules)
    reverse = tuple(_single(r.head + r.first, r.fold, True) for r in rules)
    heads = tuple(_single(r.head, r.fold, False) for r in rules)
    return Compiled(rules, determinise(machine, starts, ends, True), whole, reverse, heads)


class Memo:
    """What the last long run of an automaton found: its state at every place, and the match end it came to."""

    def __init__(self, size: int) -> None:
        self.state = np.full(size + 1, -1, np.int32)
        self.best = np.full(size + 1, -1, np.int64)


SHORT = 16  # bytes that a run reads before it is remembered


def _furthest(machine: Automaton, data: bytes, at: int, stop: int, memo: dict | None = None, name: object = None) -> int:
    """Where the longest match that begins at ``at`` and runs towards ``stop`` ends; -1 without one.

    Long runs are kept in ``memo`` under ``name``: a run that comes to a place in the state of one before would
    read the same bytes to the same end, so rules that begin again and again stay linear in the text.
    """
    step, state = (1 if stop >= at else -1), 0
    best = at if machine.accepts[0] else -1
    table, classes, accepts = machine.table, machine.classes, machine.accepts
    begun, kept, states = at, None, []
    while at != stop:
        state = table[state, classes[data[at if step > 0 else at - 1]]]
        if state == machine.dead:
            break
        at += step
        if accepts[state]:
            best = at
        if memo is not None and abs(at - begun) > SHORT:
            if kept is None:
                kept = memo[name] = memo.get(name) or Memo(len(data))
            if kept.state[at] == state:
                best = int(kept.best[at]) if kept.best[at] >= 0 else best
                break
            states.append(state)
    if states:
        places = begun + step * np.arange(SHORT + 1, SHORT + 1 + len(states))
        kept.state[places] = states
        kept.best[places] = np.where((best - places) * step >= 0, best, -1) if best >= 0 else -1
    return best


class Scanner:
    """Finds the spans of all rules in one pass over the bytes of a text."""

    def __init__(self, compiled: Compiled) -> None:
        self.compiled = compiled
        table = compiled.search
        # A row holds the rows that follow it, and its rules at the end.
        self.rows: list[list] = [[] for _ in table.table]
        for row, following, rules in zip(self.rows, table.table.tolist(), table.accepts.tolist()):
            row.extend(self.rows[s] for s in following)
            row.append(rules)
        self.bits = {m: [r for r in range(len(compiled.rules)) if m >> r & 1] for m in {*table.accepts.tolist()}}

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes: leftmost, longest and without overlap for each rule."""
        row, events = self.rows[0], []
        for at, c in enumerate(data.translate(self.compiled.search.classes), 1):
            row = row[c]
            if row[-1]:
                events.append((at, row[-1]))
        if not events:
            return []
        free, out, memo = [0] * len(self.compiled.rules), [], {}
        for at, mask in events:
            for r in self.bits[mask]:
                if at <= free[r]:
                    continue
                start = _furthest(self.compiled.reverse[r], data, at, free[r], memo, ("start", r))
                if start < 0:
                    continue
                end = _furthest(self.compiled.whole[r], data, start, len(data), memo, ("end", r))
                if end < 0:
                    continue
                free[r] = end
                rule = self.compiled.rules[r]
                if end - start >= rule.shortest and end - _furthest(self.compiled.heads[r], data, start, end) >= rule.least:
                    out.append((start, end, r))
        return sorted(out, key=lambda s: (s[0], s[2]))


def in_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte spans as code-point spans."""
    if not spans or data.isascii():
        return spans
    before = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    return [(int(before[s]), int(before[e]), r) for s, e, r in spans]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    All rules are searched in one byte pass over the UTF-8 text; where the automaton accepts the begin of a
    rule, the rule's reversed automaton finds the start and its whole automaton the end. ``spans`` lists kind:start:end in
    code points by start, then rule order; ``base_sha256`` hashes the same list of the base rules. A match
    that is too short is dropped and its text not tried again. Null and empty texts have no spans; repeated
    rows get equal answers; an empty table gives no rows; other columns are ignored.
    """
    compiled, base = compile_rules(rules), len(BASE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(compiled)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                data = (text or "").encode()
                found = in_points(data, scanner.spans(data))
                told = [f"{rules[r].kind}:{s}:{e}" for s, e, r in found]
                own = ",".join(t for t, (_, _, r) in zip(told, found) if r < base)
                counts = [sum(r == k for _, _, r in found) for k in range(base)]
                rows.append((*counts, hashlib.sha256(own.encode()).hexdigest(), ",".join(told)))
            columns = [list(c) for c in zip(*rows)] or [[] for _ in range(base + 2)]
            arrays = [pa.array(c, pa.int64()) for c in columns[:base]] + [pa.array(c, pa.string()) for c in columns[base:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *[f"n_{r.kind}" for r in BASE], "base_sha256", "spans"])

    fields = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, fields)
