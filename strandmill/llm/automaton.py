"""A combined deterministic automaton for secret rules.

A rule is a regular expression over bytes: classes, groups, alternatives and repeats, counted
ones too. Each is parsed and becomes its position automaton; subset construction over all rules
at once gives one deterministic automaton, partition refinement minimises it, and its transition
arrays are Python lists that point at each other, so that the scan is one list access a byte. A
state holds, for each rule, the positions in order of their starts (a later start yields to an
earlier one that matches), which makes the matches leftmost and longest. The automaton reports
where a match ends; the start comes from a reversed automaton of that rule, run backwards over
the match alone.

The form of a rule never needs a second look: once it matches, each further byte either extends
the match or ends it; parse() checks nothing of the kind, so rules are to be written that way.
Of two openings the one that matches first wins.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

#: Not a byte of any UTF-8 text: ends all matches at the end of a text.
END = 0xFF
_COUNT = re.compile(r"\{(\d+)(,?)(\d*)\}")


def _cased(found: frozenset[int]) -> frozenset[int]:
    return found | {ord(c) for b in found if b < 128 for c in chr(b).lower() + chr(b).upper()}


class _Parser:
    """Of a regular expression over ASCII: a node is ("set", bytes), ("cat", nodes), ("alt", nodes) or ("rep", node, least,
    most or None)."""

    def __init__(self, text: str, either_case: bool):
        self.text, self.at, self.either = text, 0, either_case

    def parse(self):
        node = self._alternatives()
        if self.at < len(self.text):
            raise ValueError(f"a stray {self.text[self.at]} in {self.text}")
        return node

    def _next(self) -> str:
        return self.text[self.at : self.at + 1]

    def _alternatives(self):
        nodes = [self._sequence()]
        while self._next() == "|":
            self.at += 1
            nodes.append(self._sequence())
        return nodes[0] if len(nodes) == 1 else ("alt", nodes)

    def _sequence(self):
        nodes = []
        while self._next() not in ("", "|", ")"):
            nodes.append(self._repeated(self._one()))
        return ("cat", nodes)

    def _repeated(self, node):
        while True:
            c = self._next()
            if c and c in "?*+":
                self.at += 1
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
            elif m := _COUNT.match(self.text, self.at):
                self.at = m.end()
                node = ("rep", node, int(m[1]), int(m[3]) if m[3] else None if m[2] else int(m[1]))
            else:
                return node

    def _one(self):
        c = self._next()
        if c == "(":
            self.at += 3 if self.text.startswith("(?:", self.at) else 1
            node = self._alternatives()
            if self._next() != ")":
                raise ValueError(f"an open group in {self.text}")
            self.at += 1
            return node
        if c == "[":
            return ("set", self._class())
        if c in "?*+{":
            raise ValueError(f"nothing to repeat in {self.text}")
        return ("set", self._case(frozenset([self._char()])))

    def _case(self, found: frozenset[int]) -> frozenset[int]:
        return _cased(found) if self.either else found

    def _char(self) -> int:
        c = self._next()
        self.at += 1
        if c != "\\":
            return ord(c)
        c = self._next()
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        if c.isalnum():
            raise ValueError(f"\\{c} isn't known")
        return ord(c)

    def _class(self) -> frozenset[int]:
        self.at += 1
        none = self._next() == "^"
        self.at += none
        found: set[int] = set()
        while self._next() != "]":
            if not self._next():
                raise ValueError(f"an open class in {self.text}")
            low = self._char()
            high = low
            if self._next() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.at += 1
                high = self._char()
            found.update(range(low, high + 1))
        self.at += 1
        whole = self._case(frozenset(found))
        return frozenset(range(END)) - whole if none else whole


def parse(text: str, either_case: bool = False):
    return _Parser(text, either_case).parse()


@dataclass(frozen=True)
class Rule:
    """pattern: a regular expression; either_case: its letters stand for both cases. A match of fewer than min_length bytes,
    or with fewer than min_last in the last item of the pattern, is dropped once found. Lengths that are checked afterwards
    need no counting states, whose product over the rules would be large. until: where a match really ends, from the text
    and the end that the automaton gives."""

    kind: str
    pattern: str
    either_case: bool = False
    min_last: int = 0
    min_length: int = 0
    until: Callable[[bytes, int], int] | None = None


class Nfa:
    """Position automaton: 0 is the start; edges[p] lists (class, next); done holds the accepting ones."""

    def __init__(self, node):
        self.edges: list[list] = [[]]
        self._sets: list = [None]
        empty, first, last = self._build(node)
        self._connect([0], first)
        self.done: set[int] = set(last) | ({0} if empty else set())

    def _connect(self, at, to) -> None:
        for p in at:
            have = {q for _, q in self.edges[p]}
            self.edges[p] += [(self._sets[q], q) for q in to if q not in have]

    def _build(self, node) -> tuple[bool, list[int], list[int]]:
        """(whether it matches nothing, positions that it may begin with, that it may end with)."""
        kind = node[0]
        if kind == "set":
            self.edges.append([])
            self._sets.append(node[1])
            p = len(self.edges) - 1
            return False, [p], [p]
        if kind == "alt":
            parts = [self._build(n) for n in node[1]]
            return any(e for e, _, _ in parts), [p for _, f, _ in parts for p in f], [p for _, _, x in parts for p in x]
        if kind == "cat":
            return self._chain([self._build(n) for n in node[1]])
        _, inner, least, most = node
        parts = [self._build(inner) for _ in range(max(1, least) if most is None else most)]
        if most is None:
            self._connect(parts[-1][2], parts[-1][1])
        parts = [(e or i >= least, f, x) for i, (e, f, x) in enumerate(parts)]
        return self._chain(parts)

    def _chain(self, parts) -> tuple[bool, list[int], list[int]]:
        empty, first, last = True, [], []
        for e, f, x in parts:
            self._connect(last, f)
            first, last = first + f if empty else first, last + x if e else x
            empty = empty and e
        return empty, first, last

    def step(self, positions, byte: int) -> list[int]:
        out: dict[int, None] = {}
        for p in positions:
            for cls, q in self.edges[p]:
                if byte in cls:
                    out.setdefault(q)
        return list(out)


def _classes(nfas) -> tuple[list[int], list[int]]:
    """Class of each byte, and a byte of each class: bytes that no rule tells apart share one."""
    sets = {cls for n in nfas for e in n.edges for cls, _ in e}
    seen: dict[tuple, int] = {}
    of, sample = [], []
    order = sorted(map(sorted, sets))
    order = [frozenset(x) for x in order]
    for b in range(256):
        key = tuple(b in s for s in order)
        if key not in seen:
            seen[key] = len(sample)
            sample.append(b)
        of.append(seen[key])
    return of, sample


def _forward(nfa: Nfa, state: tuple, byte: int) -> tuple[tuple, bool]:
    """Next (positions in start order) of one rule, and whether a match ended before this byte."""
    matching = bool(state) and state[-1] in nfa.done
    moved = nfa.step(state, byte)
    ended = matching and not moved
    if not matching or ended:  # a new start; within a match none may begin
        for q in nfa.step([0], byte):
            if q not in moved:
                moved.append(q)
    for i, p in enumerate(moved):
        if p in nfa.done:
            return tuple(moved[: i + 1]), ended
    return tuple(moved), ended


def _minimise(n: int, k: int, nxt: list[list[tuple[int, int]]]) -> list[int]:
    """Block of each state: states are one where all ways on give the same events and blocks."""
    block = [0] * n
    count = 1
    while True:
        ids: dict[tuple, int] = {}
        new = []
        for s in range(n):
            key = (block[s], tuple((block[t], e) for t, e in nxt[s]))
            new.append(ids.setdefault(key, len(ids)))
        block = new
        if len(ids) == count:
            return block
        count = len(ids)


class _Event(list):
    """A state entered as matches ended: says so when left, and goes on as the state it stands for."""

    __slots__ = ("rules", "scan")

    def __getitem__(self, byte):
        scan = self.scan
        scan.ends.append((scan.size - scan.left.__length_hint__() - 2, self.rules))
        return list.__getitem__(self, byte)


class Automaton:
    """All rules in one. find() gives the spans of every rule, each leftmost and non-overlapping within its rule."""

    def __init__(self, rules: list[Rule]):
        self.rules = list(rules)
        trees = [parse(r.pattern, r.either_case) for r in rules]
        nfas = [Nfa(t) for t in trees]
        of, sample = _classes(nfas)
        start = tuple(() for _ in nfas)
        index, todo, nxt = {start: 0}, [start], []
        while len(nxt) < len(todo):
            state, row = todo[len(nxt)], []
            for byte in sample:
                moved = [_forward(n, s, byte) for n, s in zip(nfas, state, strict=True)]
                to = tuple(m[0] for m in moved)
                if to not in index:
                    index[to] = len(todo)
                    todo.append(to)
                row.append((index[to], sum(1 << i for i, m in enumerate(moved) if m[1])))
            nxt.append(row)
        self.raw_states = len(nxt)
        block = _minimise(len(nxt), len(sample), nxt)
        self.states = max(block) + 1
        rows: list[list] = [[None] * 256 for _ in range(self.states)]
        events: dict[tuple[int, int], _Event] = {}
        for s, row in enumerate(nxt):
            for b in range(256):
                t, e = row[of[b]]
                target = block[t]
                rows[block[s]][b] = rows[target] if not e else events.setdefault((target, e), _Event())
        for (target, e), x in events.items():
            x.extend(rows[target])
            x.rules, x.scan = tuple(i for i in range(len(rules)) if e >> i & 1), self
        self._start = rows[block[0]]
        self._reverse = [self._reversed(n) for n in nfas]
        self._heads = [Nfa(("cat", t[1][:-1])) if t[0] == "cat" else None for t in trees]
        self.ends: list = []
        self.left, self.size = iter(b""), 0

    @staticmethod
    def _reversed(n: Nfa):
        """Transitions of the reversed rule by (positions, byte), filled as they are met."""
        into: list[list] = [[] for _ in n.edges]
        for p, e in enumerate(n.edges):
            for cls, q in e:
                into[q].append((cls, p))
        return into, {}, frozenset(n.done)

    def _begin(self, i: int, data: bytes, low: int, end: int) -> int:
        """The leftmost start, at low or later, of a match of rule i that ends at end."""
        into, memo, at = self._reverse[i]
        best, pos = end, end
        while pos > low and at:
            pos -= 1
            key = (at, data[pos])
            if key not in memo:
                memo[key] = frozenset(p for q in at for cls, p in into[q] if data[pos] in cls)
            at = memo[key]
            if 0 in at:
                best = pos
        return best

    def _last_part(self, i: int, data: bytes, begin: int, end: int) -> int:
        """Where the last part of the tail begins: after the longest opening."""
        nfa, at, pos, best = self._heads[i], [0], begin, begin
        while pos < end and at:
            at = nfa.step(at, data[pos])
            pos += 1
            if any(p in nfa.done for p in at):
                best = pos
        return min(best, end - 1)

    def find(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start, then rule."""
        self.ends = []
        self.size = len(data) + 2
        self.left = left = iter(data + b"\xff\xff")
        state = self._start
        for byte in left:
            state = state[byte]
        out, last = [], [0] * len(self.rules)
        for stop, which in self.ends:
            for i in which:
                end = stop
                if end <= last[i]:  # within what a match of the rule took after its end
                    continue
                begin = self._begin(i, data, last[i], end)
                if self.rules[i].until is not None:
                    end = self.rules[i].until(data, end)
                last[i] = end
                least = self.rules[i].min_last
                if end - begin >= self.rules[i].min_length and (not least or end - self._last_part(i, data, begin, end) >= least):
                    out.append((begin, i, end))
        return sorted(out)
