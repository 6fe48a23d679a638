"""Regular expressions over bytes as one minimal deterministic automaton in transition arrays."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from operator import or_

import numpy as np

ANY_CASE = {c: bytes({c, c ^ 32}) for c in [*range(65, 91), *range(97, 123)]}


class _Parser:
    """Literals, \\xHH and other escapes, classes, groups, | and the repeats ? * + {m} {m,} {m,n}; no anchors."""

    def __init__(self, pattern: str, any_case: bool = False):
        self.p, self.i, self.any_case = pattern, 0, any_case

    def parse(self):
        out = self.choice()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} in {self.p!r}")
        return out

    def choice(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self):
        items = []
        while self.peek() not in ("", "|", ")"):
            items.append(self.repeat(self.atom()))
        return ("seq", items)

    def repeat(self, node):
        while (c := self.peek()) and c in "?*+{":
            self.i += 1
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : end].partition(",")
                self.i = end + 1
                low, high = int(low), (int(high) if high else None) if comma else int(low)
            else:
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            node = ("rep", node, low, high)
        return node

    def atom(self):
        c = self.p[self.i]
        self.i += 1
        if c == "(":
            if self.p.startswith("?:", self.i):
                self.i += 2
            node = self.choice()
            if self.peek() != ")":
                raise ValueError(f"unclosed group in {self.p!r}")
            self.i += 1
            return node
        if c == "[":
            return ("set", self.klass())
        if c == "\\":
            return ("set", self.folded({self.escape()}))
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        raw = c.encode()
        return ("seq", [("set", self.folded({b})) for b in raw])

    def klass(self):
        negate = self.peek() == "^"
        self.i += negate
        found, first = set(), True
        while first or self.peek() != "]":
            first = False
            low = self.one()
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                found |= set(range(low, self.one() + 1))
            else:
                found.add(low)
        self.i += 1
        found = self.folded(found)
        return frozenset(range(256)) - found if negate else found

    def one(self) -> int:
        c = self.p[self.i]
        self.i += 1
        return self.escape() if c == "\\" else ord(c)

    def escape(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return {"n": 10, "t": 9, "r": 13, "f": 12, "v": 11}.get(c, ord(c))

    def folded(self, found) -> frozenset:
        return frozenset(x for b in found for x in ANY_CASE.get(b, bytes([b]))) if self.any_case else frozenset(found)

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]


class Automaton:
    """next: states x classes, state 0 is the start; classes: byte -> class; accepts: bit k of a state is set if rule k ends there."""

    def __init__(self, rules: list[tuple[str, bool]], search: bool, backward: bool = False):
        """rules: (pattern, any_case). search: matches may begin at any byte, else only at the first. backward: bytes come from the last to the first."""
        eps: list[set[int]] = []
        moves: list[list[tuple[frozenset, int]]] = []

        def state() -> int:
            eps.append(set())
            moves.append([])
            return len(eps) - 1

        def build(node, at: int) -> int:
            kind = node[0]
            if kind == "set":
                to = state()
                moves[at].append((node[1], to))
                return to
            if kind == "seq":
                for x in reversed(node[1]) if backward else node[1]:
                    at = build(x, at)
                return at
            if kind == "or":
                end = state()
                for x in node[1]:
                    begin = state()
                    eps[at].add(begin)
                    eps[build(x, begin)].add(end)
                return end
            _, inner, low, high = node
            for _ in range(low):
                at = build(inner, at)
            if high is None:
                loop, end = state(), state()
                eps[at] |= {loop}
                eps[build(inner, loop)].add(loop)
                eps[loop].add(end)
                return end
            for _ in range(high - low):
                to, fresh = build(inner, at), state()
                eps[at].add(fresh)
                eps[to].add(fresh)
                at = fresh
            return at

        start, ends = state(), {}
        for k, (pattern, any_case) in enumerate(rules):
            begin = state()
            eps[start].add(begin)
            end = build(_Parser(pattern, any_case).parse(), begin)
            ends[end] = ends.get(end, 0) | 1 << k

        def closure(found) -> frozenset:
            todo, seen = list(found), set(found)
            while todo:
                for x in eps[todo.pop()] - seen:
                    seen.add(x)
                    todo.append(x)
            return frozenset(seen)

        # bytes that no rule tells apart share a class
        signature = defaultdict(list)
        sets = list({s for m in moves for s, _ in m})
        for b in range(256):
            signature[tuple(b in s for s in sets)].append(b)
        groups = list(signature.values())
        self.classes = np.zeros(256, np.uint8)
        for k, group in enumerate(groups):
            self.classes[group] = k
        # subset construction
        first = closure({start})
        index, todo, rows, masks = {first: 0}, [first], [], []
        while todo:
            now = todo.pop(0)
            masks.append(reduce(or_, (ends.get(x, 0) for x in now), 0))
            row = []
            for group in groups:
                to = closure({t for x in now for s, t in moves[x] if group[0] in s} | ({start} if search else set()))
                if to not in index:
                    index[to] = len(index)
                    todo.append(to)
                row.append(index[to])
            rows.append(row)
        self.next, self.accepts = self._minimal(np.array(rows, np.int32), np.array(masks, np.int64))

    @staticmethod
    def _minimal(step: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Split blocks until states of a block agree on their accepted rules and on the blocks they lead to."""
        _, block = np.unique(masks, return_inverse=True)
        while True:
            _, fresh = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)
            fresh = fresh.reshape(-1)
            if fresh.max() == block.max():
                break
            block = fresh
        order = {}
        for b in block:  # the start's block first
            order.setdefault(int(b), len(order))
        number = np.array([order[int(b)] for b in block])
        small, keep = np.zeros((len(order), step.shape[1]), np.int32), np.zeros(len(order), np.int64)
        small[number], keep[number] = number[step], masks
        return small, keep

    def resets(self) -> np.ndarray:
        """For each byte, whether it leads every state back to the start: a text may be cut behind it."""
        return (self.next == 0).all(axis=0)[self.classes] & (self.accepts[0] == 0)

    def longest(self, data: bytes, begin: int, end: int) -> int:
        """End of the longest match that begins at begin, or -1. For automata built without search."""
        rows, classes, ok, at, best = self._lists()
        at = 0
        best = begin if ok[0] else -1
        for i in range(begin, end):
            at = rows[at][classes[data[i]]]
            if ok[at]:
                best = i + 1
            elif at == self.dead:
                break
        return best

    def ends_backward(self, data: bytes) -> list[int]:
        """Where a match of a backward search automaton may begin, in ascending order."""
        rows, classes, ok, at, _ = self._lists()
        found = []
        for i in range(len(data) - 1, -1, -1):
            at = rows[at][classes[data[i]]]
            if ok[at]:
                found.append(i)
        return found[::-1]

    def _lists(self):
        if not hasattr(self, "_cached"):
            self._cached = (self.next.tolist(), self.classes.tolist(), (self.accepts != 0).tolist(), 0, 0)
            stuck = [s for s, row in enumerate(self.next.tolist()) if set(row) == {s} and not self.accepts[s]]
            self.dead = stuck[0] if stuck else -1
        return self._cached
