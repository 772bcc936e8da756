"""Secret scanning with one deterministic automaton for all rules.

Rule expressions are parsed into one nondeterministic automaton, determinised by
subset construction over byte classes and minimised by partition refinement into a
transition array. One pass over a text's bytes yields, at each byte, the set of
rules of which some match ends there. Rare hits are then given their extent by an
anchored automaton run forward and the reversed automaton run backward from the hit,
so matches are leftmost, longest and non-overlapping within a rule.

Rules may use ASCII characters, escapes, ``.``, ``\\d \\w \\s`` (ASCII) and their negations,
classes and negated classes, plain and ``(?:)`` groups, ``|``, ``? * +`` and ``{n,m}``. A
newline parts texts, so no class matches it. What cannot be an automaton over bytes, or has
no meaning where the longest match counts, is an error: anchors, ``\\b``, lookaround,
references, lazy repeats, flags.

Defined results: a null or empty text has no spans; offsets count code points; other
columns of the input are ignored; every input row gives one output row, so repeated
rows are repeated in the output.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from operator import getitem, itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import row_batches, ship


@dataclass(frozen=True)
class Rule:
    """``least`` applies to the whole match, or to its open-ended tail if ``tail``."""

    kind: str
    pattern: str
    least: int
    tail: bool = False
    base: bool = False


# The patterns of the base kinds, then those of well-known token formats.
_KEY = "(password|passwd|secret|token|api_?key)"
_ANY_CASE = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in _KEY)
RULES = (
    Rule("assign", _ANY_CASE + "[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]+", 6, tail=True, base=True),
    Rule("access", "AKIA[A-Z0-9]+", 20, base=True),
    Rule("hex", "[0-9a-f]+", 24, base=True),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 27),
)


_ONE_CLASS = re.compile(r"\[[^]^\\]+\]\+")
_COUNT = re.compile(r"\{(?=[0-9,]*[0-9])([0-9]*)(?:(,)([0-9]*))?\}")
MOST_COPIES = 1000
_CLASSES = {"d": frozenset(range(48, 58)), "s": frozenset((9, 11, 12, 13, 32)), "w": frozenset(b for b in range(128) if chr(b).isalnum() or b == 95)}
_CONTROLS = {"t": "\t", "r": "\r", "f": "\f", "v": "\v", "n": "\n"}


# --- parsing -------------------------------------------------------------------


class _Nfa:
    """Thompson construction; ``moves[s]`` holds (byte set, target), ``free[s]`` targets."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, pattern: str) -> tuple[int, int]:
        self.text, self.at = pattern, 0
        part = self._choice()
        if self.at != len(pattern):
            raise ValueError(f"cannot parse {pattern!r} at {self.at}")
        return part

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _choice(self) -> tuple[int, int]:
        parts = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            parts.append(self._sequence())
        if len(parts) == 1:
            return parts[0]
        start, end = self.state(), self.state()
        for a, b in parts:
            self.free[start].append(a)
            self.free[b].append(end)
        return start, end

    def _sequence(self) -> tuple[int, int]:
        start = end = self.state()
        while self._peek() not in ("", "|", ")"):
            a, b = self._repeated()
            self.free[end].append(a)
            end = b
        return start, end

    def _repeated(self) -> tuple[int, int]:
        begin = self.at
        part = self._atom()
        low, high = self._bounds()
        if (low, high) == (1, 1):
            return part
        after = self.at
        start = end = self.state()
        copies = max(low, 1) if high is None else high
        for k in range(copies):
            if k:
                self.at = begin
                part = self._atom()
            a, b = part
            self.free[end].append(a)
            out = self.state()
            self.free[b].append(out)
            if k >= low:
                self.free[end].append(out)
            if high is None and k == copies - 1:
                self.free[b].append(a)
            end = out
        self.at = after
        return start, end

    def _bounds(self) -> tuple[int, int | None]:
        """How often the part before may come; None: any number of times."""
        found = _COUNT.match(self.text, self.at)
        if found:
            low, comma, high = found.groups()
            low, high = int(low or 0), (int(high) if high else None) if comma else int(low)
        elif (sign := self._peek()) and sign in "?*+":
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[sign]
        else:
            return 1, 1
        self.at = found.end() if found else self.at + 1
        if self._peek() and (self._peek() in "?*+" or _COUNT.match(self.text, self.at)):
            raise ValueError(f"lazy, possessive and double repeats are not supported: {self.text!r} at {self.at}")
        if max(low, high or 0) > MOST_COPIES or high is not None and high < low or high == 0:
            raise ValueError(f"cannot repeat {low} to {high} times in {self.text!r}")
        return low, high

    def _atom(self) -> tuple[int, int]:
        sign = self._peek()
        if sign == "(":
            self.at += 1
            if self._peek() == "?":
                if self.text[self.at : self.at + 2] != "?:":
                    raise ValueError(f"only plain and (?:...) groups are supported: {self.text!r} at {self.at}")
                self.at += 2
            part = self._choice()
            if self._peek() != ")":
                raise ValueError(f"unclosed group in {self.text!r}")
            self.at += 1
            return part
        if sign == "":
            raise ValueError(f"{self.text!r} ends too early")
        if sign in "^$":
            raise ValueError(f"anchors are not supported: {self.text!r} at {self.at}")
        if sign in "?*+":
            raise ValueError(f"nothing to repeat in {self.text!r} at {self.at}")
        if sign == "[":
            members, wide = self._members()
        elif sign == ".":
            self.at += 1
            members, wide = frozenset(range(128)), True
        else:
            members, wide = self._literal()
        a, b = self.state(), self.state()
        if members := members - {10}:
            self.moves[a].append((members, b))
        if wide:  # any character beyond ASCII, as its UTF-8 bytes
            more = frozenset(range(0x80, 0xC0))
            for lead, rest in ((range(0xC2, 0xE0), 1), (range(0xE0, 0xF0), 2), (range(0xF0, 0xF5), 3)):
                at = self.state()
                self.moves[a].append((frozenset(lead), at))
                for k in range(rest):
                    to = b if k == rest - 1 else self.state()
                    self.moves[at].append((more, to))
                    at = to
        return a, b

    def _literal(self) -> tuple[frozenset[int], bool]:
        """ASCII members of a character or an escape, and whether all others are members too."""
        sign = self._peek()
        self.at += 1
        if sign == "\\":
            sign = self._peek()
            self.at += 1
            if sign.lower() in _CLASSES and sign:
                members = _CLASSES[sign.lower()]
                return (members, False) if sign.islower() else (frozenset(range(128)) - members, True)
            if sign == "x" and re.fullmatch("[0-9a-fA-F]{2}", self.text[self.at : self.at + 2]):
                sign = chr(int(self.text[self.at : self.at + 2], 16))
                self.at += 2
            elif sign in _CONTROLS and sign:
                sign = _CONTROLS[sign]
            elif sign.isalnum() or not sign:
                raise ValueError(f"escape \\{sign} is not supported in {self.text!r}")
        if ord(sign) > 127:
            raise ValueError("rules are over ASCII")
        if sign == "\n":
            raise ValueError("a newline parts texts, so no rule may match it")
        return frozenset([ord(sign)]), False

    def _members(self) -> tuple[frozenset[int], bool]:
        self.at += 1
        negated = self._peek() == "^"
        self.at += negated
        found: set[int] = set()
        wide, first = False, True
        while self._peek() != "]" or first:
            if not self._peek():
                raise ValueError(f"unclosed class in {self.text!r}")
            first = False
            low, all_others = self._literal()
            found |= low
            wide |= all_others
            if self._peek() == "-" and self.text[self.at + 1 : self.at + 2] not in ("]", ""):
                self.at += 1
                high, _ = self._literal()
                if len(low) > 1 or len(high) > 1 or min(high) < min(low):
                    raise ValueError(f"bad range in {self.text!r} at {self.at}")
                found.update(range(min(low), min(high) + 1))
        self.at += 1
        return (frozenset(range(128)) - found, not wide) if negated else (frozenset(found), wide)

    def reach(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def reversed(self, start: int, end: int) -> tuple[_Nfa, int, int]:
        other = _Nfa()
        for _ in self.moves:
            other.state()
        for s, moves in enumerate(self.moves):
            for members, t in moves:
                other.moves[t].append((members, s))
            for t in self.free[s]:
                other.free[t].append(s)
        return other, end, start


# --- determinising and minimising ----------------------------------------------


@dataclass(frozen=True)
class Dfa:
    """``table[state, classes[byte]]`` is the next state; ``accept[state]`` a rule bit set."""

    classes: np.ndarray
    table: np.ndarray
    accept: np.ndarray
    start: int


def _byte_classes(nfa: _Nfa) -> tuple[np.ndarray, list[int]]:
    sets = {members for moves in nfa.moves for members, _ in moves}
    ordered = sorted(sets, key=sorted)
    marks = {}
    classes = np.zeros(256, dtype=np.uint8)
    examples: list[int] = []
    for byte in range(256):
        key = tuple(byte in members for members in ordered)
        if key not in marks:
            marks[key] = len(marks)
            examples.append(byte)
        classes[byte] = marks[key]
    return classes, examples


def determinise(nfa: _Nfa, starts: list[int], ends: dict[int, int], floating: bool) -> Dfa:
    """Subset construction. ``floating``: a match may begin at any byte."""
    classes, examples = _byte_classes(nfa)
    first = nfa.reach(starts)
    index, todo, rows = {first: 0}, [first], []
    while todo:
        states = todo.pop(0)
        row = []
        for byte in examples:
            after = {t for s in states for members, t in nfa.moves[s] if byte in members}
            reached = nfa.reach(after | set(starts) if floating else after)
            if reached not in index:
                index[reached] = len(index)
                todo.append(reached)
            row.append(index[reached])
        rows.append(row)
    accept = np.array([sum({1 << ends[s] for s in states if s in ends}) for states in index], dtype=object)
    return minimise(Dfa(classes, np.array(rows), accept, 0))


def minimise(dfa: Dfa) -> Dfa:
    """Refine the partition by accept set until successors agree; one state a block."""
    _, block = np.unique(dfa.accept, return_inverse=True)
    while True:
        signature = np.column_stack([block, block[dfa.table]])
        _, finer = np.unique(signature, axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    chosen = np.array([np.flatnonzero(block == b)[0] for b in range(block.max() + 1)])
    return Dfa(dfa.classes, block[dfa.table[chosen]], dfa.accept[chosen], int(block[dfa.start]))


def compile_rules(rules: tuple[Rule, ...] = RULES) -> tuple[Dfa, list[tuple[Dfa, Dfa]]]:
    """The combined automaton, and per rule the anchored forward and backward ones."""
    joint, starts, ends, single = _Nfa(), [], {}, []
    for k, rule in enumerate(rules):
        a, b = joint.add(rule.pattern)
        starts.append(a)
        ends[b] = k
        own = _Nfa()
        c, d = own.add(rule.pattern)
        back, e, f = own.reversed(c, d)
        single.append((determinise(own, [c], {d: 0}, False), determinise(back, [e], {f: 0}, False)))
    return determinise(joint, starts, ends, True), single


# --- scanning --------------------------------------------------------------------


class Scanner:
    def __init__(self, rules: tuple[Rule, ...], dfa: Dfa, single: list[tuple[Dfa, Dfa]]) -> None:
        self.rules = rules
        self.classes = dfa.classes.tobytes()
        rows: list[list] = [[] for _ in dfa.table]
        sets = sorted({0, *dfa.accept.tolist()})  # sets of rules that end together; the empty one comes first
        number = {s: k for k, s in enumerate(sets)}
        self.ends = [np.array([s >> k & 1 == 1 for s in sets]) for k in range(len(rules))]
        self.few = len(sets) <= 256
        self.plain = [_ONE_CLASS.fullmatch(rule.pattern) is not None for rule in rules]
        for row, targets, mask in zip(rows, dfa.table.tolist(), dfa.accept.tolist(), strict=True):
            row.extend(rows[t] for t in targets)
            row.append(number[mask])
        self.start, self.mask = rows[dfa.start], itemgetter(dfa.table.shape[1])
        self.single = [tuple((d.classes.tolist(), d.table.tolist(), d.accept.tolist(), d.start) for d in pair) for pair in single]

    def _run(self, machine, data: bytes, order) -> tuple[int, int]:
        """First and last position, in the order of travel, at which it accepts; -1 if none."""
        classes, table, accept, state = machine
        dead = -1
        first = last = -1
        for i in order:
            after = table[state][classes[data[i]]]
            if after == state and not accept[state] and all(t == state for t in table[state]):
                break
            state = after
            if accept[state]:
                last = i
                if first < 0:
                    first = i
            elif last >= 0 and dead == state:
                break
        return first, last

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, sorted."""
        found: list[tuple[int, int, int]] = []
        if not data:
            return found
        path = accumulate(data.translate(self.classes), getitem, initial=self.start)
        next(path)
        marks = map(self.mask, path)
        masks = np.frombuffer(bytes(marks), np.uint8) if self.few else np.frombuffer(array("I", marks), np.uint32)
        hits = np.flatnonzero(masks)
        for k, rule in enumerate(self.rules):
            at = hits[self.ends[k][masks[hits]]]
            if not len(at):
                continue
            cuts = np.flatnonzero(np.diff(at) > 1)
            firsts, lasts = at[np.r_[0, cuts + 1]], at[np.r_[cuts, len(at) - 1]]
            if self.plain[k]:  # an unbounded run of one class: its hits are its bytes
                long = lasts - firsts + 1 >= rule.least
                found.extend((int(a), k, int(b) + 1) for a, b in zip(firsts[long], lasts[long], strict=True))
                continue
            forward, backward = self.single[k]
            free = 0
            for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True):
                hit = max(a, free)
                while hit <= b:
                    _, start = self._run(backward, data, range(hit, free - 1, -1))
                    if start < 0:
                        hit += 1
                        continue
                    first, last = self._run(forward, data, range(start, len(data)))
                    free = last + 1
                    if free - (first if rule.tail else start) >= rule.least:
                        found.append((start, k, free))
                    hit = free
        found.sort()
        return found


def _reports(scanner: Scanner, texts) -> list[tuple]:
    """Texts are scanned as one run of bytes; no rule holds the newline between them."""
    parts = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
    begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
    spans: list[list] = [[] for _ in parts]
    for a, k, b in scanner.spans(b"\n".join(parts)):
        i = int(np.searchsorted(begins, a, side="right")) - 1
        spans[i].append((a - int(begins[i]), k, b - int(begins[i])))
    return [_report(scanner.rules, *pair) for pair in zip(parts, spans, strict=True)]


def _report(rules: tuple[Rule, ...], data: bytes, spans: list) -> tuple:
    if spans and not data.isascii():
        marks = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        place = lambda i: int(marks[i - 1]) if i else 0
        spans = [(place(a), k, place(b)) for a, k, b in spans]
    counts = [0] * len(rules)
    for _, k, _ in spans:
        counts[k] += 1
    said = [(rules[k].base, f"{rules[k].kind}:{a}:{b}") for a, k, b in spans]
    base = ",".join(s for is_base, s in said if is_base)
    return counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(s for _, s in said)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, ``n_<kind>`` for each rule, base_sha256, spans."""
    ship(docs.sparkSession)
    dfa, single = compile_rules(rules)
    id_type = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {id_type}, " + ", ".join(f"n_{r.kind} long" for r in rules) + ", base_sha256 string, spans string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(rules, dfa, single)
        for frame in row_batches(frames, column=text_col):
            rows = _reports(scanner, frame[text_col])
            out = {id_col: frame[id_col].array}
            for k, rule in enumerate(rules):
                out[f"n_{rule.kind}"] = [r[0][k] for r in rows]
            out["base_sha256"] = [r[1] for r in rows]
            out["spans"] = [r[2] for r in rows]
            yield pd.DataFrame(out)

    return docs.select(id_col, text_col).mapInPandas(run, schema)
