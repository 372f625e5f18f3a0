"""Deterministic automata over bytes: regex rules to one minimal automaton, and scans of many texts in lockstep.

Rules are parsed to an NFA, determinised together by subset construction, minimised by partition refinement and
stored as flat transition arrays. A scan cuts the texts into segments, runs all segments one byte at a time side
by side, and reruns segments whose true entry state turns out to be another than the start state. Compiled
backwards, an automaton that reads a text from its end marks the places where matches begin.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ANY = frozenset(range(256))


class Nfa:
    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.arc: list[tuple[frozenset[int], int] | None] = []

    def new(self) -> int:
        self.eps.append([])
        self.arc.append(None)
        return len(self.eps) - 1


class _Parser:
    """Bytes, classes, groups, ``|`` and the quantifiers ``? * + {n} {n,} {n,m}``; ``(?i:`` folds ASCII letters."""

    def __init__(self, rule: str) -> None:
        self.s, self.i = rule.encode(), 0

    def peek(self) -> bytes:
        return self.s[self.i : self.i + 1]

    def take(self) -> int:
        self.i += 1
        return self.s[self.i - 1]

    def either(self, fold: bool):
        parts = [self.row(fold)]
        while self.peek() == b"|":
            self.i += 1
            parts.append(self.row(fold))
        return ("or", parts) if len(parts) > 1 else parts[0]

    def row(self, fold: bool):
        parts = []
        while self.peek() not in (b"", b"|", b")"):
            parts.append(self.counted(self.atom(fold)))
        return ("row", parts)

    def atom(self, fold: bool):
        c = self.take()
        if c == ord("("):
            if self.s[self.i : self.i + 3] == b"?i:":
                self.i, fold = self.i + 3, True
            elif self.s[self.i : self.i + 2] == b"?:":
                self.i += 2
            inner = self.either(fold)
            if self.take() != ord(")"):
                raise ValueError("missing )")
            return inner
        if c == ord("["):
            return ("set", self.chars(fold))
        if c == ord("."):
            return ("set", ANY - {10})
        return ("set", self.folded({self.escaped() if c == ord("\\") else c}, fold))

    def escaped(self) -> int:
        c = self.take()
        if c == ord("x"):
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return {ord("n"): 10, ord("t"): 9, ord("r"): 13}.get(c, c)

    @staticmethod
    def folded(s: set[int], fold: bool) -> frozenset[int]:
        more = {b ^ 32 for b in s if chr(b).isalpha() and b < 128} if fold else set()
        return frozenset(s | more)

    def chars(self, fold: bool) -> frozenset[int]:
        flip = self.peek() == b"^"
        self.i += flip
        out: set[int] = set()
        while (c := self.take()) != ord("]"):
            low = self.escaped() if c == ord("\\") else c
            if self.peek() == b"-" and self.s[self.i + 1 : self.i + 2] != b"]":
                self.i += 1
                high = self.take()
                out |= set(range(low, (self.escaped() if high == ord("\\") else high) + 1))
            else:
                out.add(low)
        s = self.folded(out, fold)
        return ANY - s if flip else s

    def counted(self, atom):
        while (q := self.peek()) in (b"?", b"*", b"+", b"{") and q:
            self.i += 1
            low, high = {b"?": (0, 1), b"*": (0, None), b"+": (1, None)}.get(q, (0, 0))
            if q == b"{":
                end = self.s.index(b"}", self.i)
                a, comma, b = self.s[self.i : end].decode().partition(",")
                low, high, self.i = int(a), (int(b) if b else None) if comma else int(a), end + 1
            atom = ("rep", atom, low, high)
        return atom


def _build(nfa: Nfa, tree, start: int, backwards: bool = False) -> int:
    kind = tree[0]
    if kind == "set":
        end = nfa.new()
        hop = nfa.new()
        nfa.eps[start].append(hop)
        nfa.arc[hop] = (tree[1], end)
        return end
    if kind == "row":
        for part in reversed(tree[1]) if backwards else tree[1]:
            start = _build(nfa, part, start, backwards)
        return start
    if kind == "or":
        end = nfa.new()
        for part in tree[1]:
            first = nfa.new()
            nfa.eps[start].append(first)
            nfa.eps[_build(nfa, part, first, backwards)].append(end)
        return end
    _, atom, low, high = tree
    for _ in range(low):
        start = _build(nfa, atom, start, backwards)
    end = nfa.new()
    if high is None:
        loop = nfa.new()
        nfa.eps[start].append(loop)
        nfa.eps[_build(nfa, atom, loop, backwards)].append(loop)
        nfa.eps[loop].append(end)
        return end
    for _ in range(high - low):
        nfa.eps[start].append(end)
        start = _build(nfa, atom, start, backwards)
    nfa.eps[start].append(end)
    return end


@dataclass(frozen=True)
class Dfa:
    """step: next state x 256 for state x 256 + byte; seen: the bits of rules that the next state accepts."""

    step: np.ndarray
    seen: np.ndarray
    states: int


def compiled(rules: list[str], backwards: bool = False, anywhere: bool = True) -> Dfa:
    """One minimal automaton that reports, at each byte, the set of rules (bit i for rule i, 16 at most) of which a match ends there.

    backwards: it reads texts from their end, so what it reports is where matches begin. Without anywhere a match
    begins with the first byte read, and state -1 (a negative step) is one that no match comes from.
    """
    if len(rules) > 16:
        raise ValueError("at most 16 rules share an automaton")
    nfa = Nfa()
    start, accept = nfa.new(), {}
    for i, rule in enumerate(rules):
        first = nfa.new()
        nfa.eps[start].append(first)
        accept[_build(nfa, _Parser(rule).either(False), first, backwards)] = 1 << i

    def closure(states) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for x in nfa.eps[todo.pop()]:
                if x not in out:
                    out.add(x)
                    todo.append(x)
        return frozenset(x for x in out if nfa.arc[x] or x in accept)

    # Bytes that no rule tells apart share a class.
    marks = [s for s in {a[0] for a in nfa.arc if a}]
    klass: dict[tuple[bool, ...], int] = {}
    of = np.array([klass.setdefault(tuple(b in s for s in marks), len(klass)) for b in range(256)])
    sample = [int(np.flatnonzero(of == k)[0]) for k in range(len(klass))]
    base = closure([start])
    ids, order, rows, again = {base: 0}, [base], [], base if anywhere else frozenset()
    for state in order:
        row = []
        for b in sample:
            to = closure({nfa.arc[x][1] for x in state if nfa.arc[x] and b in nfa.arc[x][0]}) | again
            if to not in ids:
                ids[to] = len(order)
                order.append(to)
            row.append(ids[to])
        rows.append(row)
    table = np.array(rows, dtype=np.int64)
    bits = np.array([sum(accept[x] for x in s if x in accept) for s in order], dtype=np.int64)
    # Minimisation: split the blocks of states until successors agree.
    block = np.unique(bits, return_inverse=True)[1]
    while True:
        split = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if split.max() == block.max():
            break
        block = split
    n = int(block.max()) + 1
    first = np.array([int(np.flatnonzero(block == k)[0]) for k in range(n)])
    renumber = np.argsort(np.argsort(np.where(np.arange(n) == block[0], -1, np.arange(n))))  # the start state is 0
    small, small_bits = np.empty((n, table.shape[1]), np.int64), np.empty(n, np.int64)
    small[renumber], small_bits[renumber] = renumber[block[table[first]]], bits[first]
    full = small[:, of]
    seen = small_bits[full].astype(np.uint16).ravel()
    if frozenset() in ids:
        full = np.where(full == renumber[block[ids[frozenset()]]], -1, full)
    return Dfa((full * 256).astype(np.int32).ravel(), seen, n)


#: Bytes that a segment has.
SEGMENT = 512


def places(dfa: Dfa, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in ``data`` rules are reported, rising, and which (bits); each text (data[start : start + size]) is read by itself."""
    per = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(starts)), per)
    if not len(owner):
        return np.zeros(0, np.int64), np.zeros(0, np.uint16)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    begin = starts[owner] + nth * SEGMENT
    length = np.minimum(SEGMENT, sizes[owner] - nth * SEGMENT)
    entry, end = np.zeros(len(owner), np.int32), np.zeros(len(owner), np.int32)
    some = np.zeros(len(owner), bool)
    todo = np.arange(len(owner))
    while len(todo):
        todo = todo[np.argsort(-length[todo], kind="stable")]
        acc = np.zeros(len(todo), np.uint16)
        for k, at, state in _lockstep(dfa, data, begin[todo], length[todo], entry[todo]):
            acc[:k] |= dfa.seen.take(at)
        end[todo], some[todo] = state, acc != 0
        true = np.zeros(len(owner), np.int32)
        true[1:] = np.where(owner[1:] == owner[:-1], end[:-1], 0)
        todo = np.flatnonzero(true != entry)
        entry = true
    # Segments that report something are few: they are read once more, now from their true entry states.
    todo = np.flatnonzero(some)
    todo = todo[np.argsort(-length[todo], kind="stable")]
    where, bits = [np.zeros(0, np.int64)], [np.zeros(0, np.uint16)]
    for t, (k, at, _) in enumerate(_lockstep(dfa, data, begin[todo], length[todo], entry[todo])):
        seen = dfa.seen.take(at)
        hit = np.flatnonzero(seen)
        where.append(begin[todo[:k]][hit] + t)
        bits.append(seen[hit])
    at, what = np.concatenate(where), np.concatenate(bits)
    order = np.argsort(at, kind="stable")
    return at[order], what[order]


def _lockstep(dfa: Dfa, data: np.ndarray, begin: np.ndarray, length: np.ndarray, entry: np.ndarray):
    """Segments, the longest first, a byte at a time: how many have one, where they are in the tables, and all states."""
    state, pos = entry.copy(), begin.copy()
    if not len(state):
        return
    alive = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
    for k in alive.tolist():
        at = state[:k] + data[pos[:k]]
        state[:k] = dfa.step.take(at)
        pos[:k] += 1
        yield k, at, state


def rules_seen(dfa: Dfa, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each text (rising starts) the bits of the rules that are reported somewhere in it."""
    out = np.zeros(len(starts), np.uint16)
    at, bits = places(dfa, data, starts, sizes)
    np.bitwise_or.at(out, np.searchsorted(starts, at, side="right") - 1, bits)
    return out


class Anchored:
    """A rule's forward automaton as plain lists, for runs of a few bytes."""

    def __init__(self, rule: str) -> None:
        dfa = compiled([rule], anywhere=False)
        self.step = [[x // 256 for x in row] for row in dfa.step.reshape(-1, 256).tolist()]
        self.seen = dfa.seen.reshape(-1, 256).tolist()

    def longest(self, data: bytes, start: int) -> int:
        """The end of the longest match that begins at ``start``; ``start`` if there is none."""
        step, seen, state, end = self.step, self.seen, 0, start
        for i in range(start, len(data)):
            byte = data[i]
            if seen[state][byte]:
                end = i + 1
            if (state := step[state][byte]) < 0:
                break
        return end
