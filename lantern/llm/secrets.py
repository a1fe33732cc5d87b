"""Secret scans: the rules' expressions in one automaton, by subset construction and minimisation."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from re import _constants as op
from re import _parser as grammar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.runtime import small_batches


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` of one kind; those that ``keep`` doesn't match from end to end are dropped after they have taken their place."""

    kind: str
    pattern: str
    keep: str


#: Fixed: assignments with a value of 12 characters, access keys of 18 and hexadecimal runs of 16. A shorter
#: run of hexadecimal digits has no other match in it, so its length stands in the pattern itself.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}"""),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}", r"[0-9a-f]{16,}"),
)
#: Fixed: published forms of keys and tokens of public services, and of what carries them.
SERVICES = (
    Rule("temporary", r"ASIA[A-Z0-9]+", r"ASIA[A-Z0-9]{14,}"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]+", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]+", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]+", r"[rs]k_(live|test)_[A-Za-z0-9]{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9+/_.=~-]+", r"[Bb]earer\x20+[A-Za-z0-9+/_.=~-]{20,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + SERVICES


class Nfa:
    """States with steps on sets of bytes and steps on nothing; one fragment per expression."""

    def __init__(self):
        self.steps: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.steps.append([])
        self.empty.append([])
        return len(self.steps) - 1

    def add(self, pattern: str) -> tuple[int, int]:
        """First and last state of a fragment for an expression of ASCII characters, classes, groups, choices and repeats."""
        first = self.state()
        return first, self._sequence(grammar.parse(pattern), first, False)

    def _sequence(self, tree, at: int, fold: bool) -> int:
        for kind, value in tree:
            at = self._item(kind, value, at, fold)
        return at

    def _item(self, kind, value, at: int, fold: bool) -> int:
        if kind is op.LITERAL:
            return self._step(at, {value}, fold)
        if kind is op.IN and not any(k is op.NEGATE for k, _ in value):
            return self._step(at, {c for k, v in value for c in ([v] if k is op.LITERAL else range(v[0], v[1] + 1))}, fold)
        if kind is op.SUBPATTERN:
            return self._sequence(value[3], at, fold or bool(value[1] & re.IGNORECASE))
        if kind is op.BRANCH:
            end = self.state()
            for tree in value[1]:
                self.empty[self._sequence(tree, at, fold)].append(end)
            return end
        if kind is op.MAX_REPEAT:
            low, high, tree = value
            for _ in range(low):
                at = self._sequence(tree, at, fold)
            if high is op.MAXREPEAT:
                # A loop state of its own: what came before must not be entered again.
                loop = self.state()
                self.empty[at].append(loop)
                self.empty[self._sequence(tree, loop, fold)].append(loop)
                return loop
            end = self.state()
            for _ in range(high - low):
                self.empty[at].append(end)
                at = self._sequence(tree, at, fold)
            self.empty[at].append(end)
            return end
        raise ValueError(f"not supported in a rule: {kind}")

    def _step(self, at: int, chars: Iterable[int], fold: bool) -> int:
        own = set(chars)
        if fold:
            own |= {ord(x) for c in own if c < 128 for x in (chr(c).lower(), chr(c).upper())}
        if max(own) > 127:
            raise ValueError("rules are expressions over ASCII")
        to = self.state()
        self.steps[at].append((frozenset(own), to))
        return to

    def reverse(self) -> Nfa:
        """The same states with every step turned round."""
        out = Nfa()
        for _ in self.steps:
            out.state()
        for a, steps in enumerate(self.steps):
            for chars, b in steps:
                out.steps[b].append((chars, a))
            for b in self.empty[a]:
                out.empty[b].append(a)
        return out

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        found = set(states)
        todo = list(found)
        while todo:
            for b in self.empty[todo.pop()]:
                if b not in found:
                    found.add(b)
                    todo.append(b)
        return frozenset(found)


def byte_classes(nfa: Nfa) -> np.ndarray:
    """The class of every byte: bytes that no step tells apart share one."""
    sets = sorted({chars for steps in nfa.steps for chars, _ in steps}, key=sorted)
    member = np.array([[b in s for s in sets] for b in range(256)])
    return np.unique(member, axis=0, return_inverse=True)[1].ravel().astype(np.uint8)


def determinise(nfa: Nfa, starts: Sequence[Iterable[int]], again: Iterable[int], marks: Sequence[int], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Transition table over byte classes, the bits of ``marks`` in each state, and the states of ``starts``.

    With ``again`` its states are entered anew at every byte, so the automaton searches; without, it
    is anchored, and state 0 is the dead one.
    """
    some = [int(np.flatnonzero(classes == c)[0]) for c in range(classes.max() + 1)]
    anew = nfa.closure(again)
    sets: dict[frozenset[int], int] = {}
    order: list[frozenset[int]] = []

    def number(own: frozenset[int]) -> int:
        if own not in sets:
            sets[own] = len(order)
            order.append(own)
        return sets[own]

    number(anew)
    entries = [number(nfa.closure(s) | anew) for s in starts]
    rows: list[list[int]] = []
    while len(rows) < len(order):
        own = order[len(rows)]
        steps = [x for s in own for x in nfa.steps[s]]
        rows.append([number(nfa.closure(b for chars, b in steps if byte in chars) | anew) for byte in some])
    bits = np.array([sum(1 << i for i, m in enumerate(marks) if m in own) for own in order], dtype=np.int64)
    return np.array(rows, dtype=np.int64), bits, entries


def minimise(table: np.ndarray, bits: np.ndarray, entries: Sequence[int]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The least automaton with the same marks: blocks of states are split until the steps of a block's states agree."""
    block = np.unique(bits, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    # States with marks come last, so that one comparison tells them.
    kinds, member = np.unique(block, return_index=True)
    order = np.argsort(bits[member] != 0, kind="stable")
    new = np.empty(len(kinds), dtype=np.int64)
    new[order] = np.arange(len(kinds))
    member = member[order]
    return new[block[table[member]]], bits[member], [int(new[block[e]]) for e in entries]


class Automaton:
    """All rules compiled: a searching automaton that reads a text once, from its end, and an anchored one.

    The first marks every byte at which a match of a rule begins. The second goes from such a byte
    that is free to the end of the longest match, so only bytes of matches are read again.
    """

    def __init__(self, rules: Sequence[Rule]):
        self.rules = tuple(rules)
        nfa = Nfa()
        whole = [nfa.add(r.pattern) for r in rules]
        keeps = [nfa.add(r.keep) for r in rules]
        classes = byte_classes(nfa)
        self.classes = classes.tobytes()
        width = int(classes.max()) + 1
        ends, starts = [e for _, e in whole], [s for s, _ in whole]
        back, bits, entry = minimise(*determinise(nfa.reverse(), [ends], ends, starts, classes))
        self.size, self.back_start = len(back), entry[0] * width
        self.first_marked = int(np.flatnonzero(bits)[0]) * width
        self.back = (back * width).ravel().tolist()
        self.begins = [tuple(k for k in range(len(rules)) if b >> k & 1) for b in bits.tolist()]
        marks = [*ends, *(e for _, e in keeps)]
        # An anchored automaton for each rule, all in one table; the empty set is its dead state.
        ahead, bits, entries = minimise(*determinise(nfa, [(s, k[0]) for s, k in zip(starts, keeps, strict=True)], (), marks, classes))
        self.dead = int(next(i for i in range(len(ahead)) if not bits[i] and (ahead[i] == i).all())) * width
        self.ahead, self.ahead_start, self.ends = (ahead * width).ravel().tolist(), [e * width for e in entries], bits.tolist()
        self.width = width

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """``(rule, start, end)`` of the kept matches, leftmost and apart from each other per rule, by start and rule."""
        own = data.translate(self.classes)
        table, state, marked = self.back, self.back_start, self.first_marked
        places, states = array("q"), array("q")
        for at, c in zip(range(len(own) - 1, -1, -1), reversed(own), strict=True):
            state = table[state + c]
            if state >= marked:
                places.append(at)
                states.append(state)
        free = [0] * len(self.rules)
        out = []
        for at, state in zip(reversed(places), reversed(states), strict=True):
            for k in self.begins[state // self.width]:
                if at >= free[k]:
                    end, kept = self._longest(own, k, at)
                    free[k] = end
                    if kept:
                        out.append((k, at, end))
        return sorted(out, key=lambda x: (x[1], x[0]))

    def _longest(self, own: bytes, k: int, at: int) -> tuple[int, bool]:
        table, state, dead, width, ends = self.ahead, self.ahead_start[k], self.dead, self.width, self.ends
        match, keep = 1 << k, 1 << (k + len(self.rules))
        end, kept = at, False
        for i in range(at, len(own)):
            state = table[state + own[i]]
            if state == dead:
                break
            bits = ends[state // width]
            if bits & match:
                end, kept = i + 1, bool(bits & keep)
        return end, kept


def _in_characters(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Offsets of bytes as offsets of code points."""
    if not spans or data.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)])
    return [(k, int(before[s]), int(before[e])) for k, s, e in spans]


def scan_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans`` for every row: ``spans`` are the ``kind, start, end`` of what the rules find in its whole text.

    Rules are compiled to one automaton on the driver, a table of fixed size, which the executors
    get; texts are read where they lie and nothing is shuffled. Matches of a rule are leftmost,
    longest and don't overlap; those of other rules may. Spans count code points, ends exclusive, and
    come by start and then by the order of ``rules``.

    Null and empty texts have no spans. Repeated rows give a row each, null ids stay null, an empty
    table gives no rows, and other columns play no part.
    """
    small_batches(docs.sparkSession)
    machine = docs.sparkSession.sparkContext.broadcast(Automaton(rules))
    kinds = pa.array([r.kind for r in rules], pa.string())

    def scan_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rule, start, end, offsets = array("q"), array("q"), array("q"), [0]
            for value in batch.column(1):
                data = value.as_buffer().to_pybytes() if value.is_valid else b""
                for k, s, e in _in_characters(data, machine.value.scan(data)):
                    rule.append(k)
                    start.append(s)
                    end.append(e)
                offsets.append(len(rule))
            parts = [kinds.take(pa.array(rule, pa.int64())), pa.array(start, pa.int64()), pa.array(end, pa.int64())]
            spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, ["kind", "start", "end"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], ["doc_id", "spans"])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(scan_all, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def span_digest(spans: DataFrame, base: Sequence[Rule] = BASE) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans`` from the spans of ``scan_secrets``: counts of the base kinds, and spans as text."""

    def of(kinds: list[str]) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(kinds))

    def joined(c: Column) -> Column:
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.size(of([r.kind])).cast("long").alias(f"n_{r.kind}") for r in base]
    own = joined(of([r.kind for r in base]))
    return spans.select("doc_id", *counts, F.sha2(own, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
