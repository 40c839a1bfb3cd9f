"""Rule regexes as one deterministic byte automaton: subset construction, minimisation, transition arrays, one pass.

A searching automaton adds the start states after every byte, so a state tells for each rule whether a match ends here. An
anchored one follows a match from its first byte on, or, reversed, from its last byte back. Rules are ASCII regexes of literals,
classes, groups, alternatives and repetitions.
"""

from __future__ import annotations

import re
from collections import deque
from re import _constants as C
from re import _parser

import numpy as np

#: Bytes after which a lane may be cut, at least.
LANE = 256
#: With so few lanes left, each is followed by itself.
FEW = 24


class _Nfa:
    """Thompson construction: per state a set of bytes with a target, or empty moves; ``reverse``: of the words read from their end."""

    def __init__(self, reverse: bool = False):
        self.reverse = reverse
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, items, start: int, fold: bool) -> int:
        """The state in which a match of ``items`` that begins in ``start`` ends."""
        for op, arg in reversed(list(items)) if self.reverse else items:
            if op in (C.LITERAL, C.NOT_LITERAL, C.IN, C.ANY):
                end = self.state()
                self.moves[start].append((_bytes_of(op, arg, fold), end))
            elif op is C.SUBPATTERN:
                end = self.add(arg[3], start, (fold or bool(arg[1] & re.I)) and not arg[2] & re.I)
            elif op is C.BRANCH:
                end = self.state()
                for branch in arg[1]:
                    first = self.state()
                    self.empty[start].append(first)
                    self.empty[self.add(branch, first, fold)].append(end)
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                low, high, what = arg
                end = start
                for _ in range(low):
                    end = self.add(what, end, fold)
                if high is C.MAXREPEAT:
                    loop = self.state()
                    self.empty[end].append(loop)
                    self.empty[self.add(what, loop, fold)].append(loop)
                    end = loop
                else:
                    out = self.state()
                    for _ in range(high - low):
                        self.empty[end].append(out)
                        end = self.add(what, end, fold)
                    self.empty[end].append(out)
                    end = out
            else:
                raise ValueError(f"a rule uses {op}, which has no byte automaton here")
            start = end
        return start


def _bytes_of(op, arg, fold: bool) -> frozenset[int]:
    if op is C.ANY:
        return frozenset(range(256)) - {10}
    found: set[int] = set()
    negated = op is C.NOT_LITERAL
    for kind, value in [(C.LITERAL, arg)] if op in (C.LITERAL, C.NOT_LITERAL) else arg:
        if kind is C.LITERAL:
            found.add(value)
        elif kind is C.RANGE:
            found.update(range(value[0], value[1] + 1))
        elif kind is C.NEGATE:
            negated = True
        else:
            raise ValueError(f"a rule uses the class {value}, which has no byte set here")
    if fold:
        found |= {b ^ 0x20 for b in found if chr(b).isascii() and chr(b).isalpha()}
    return frozenset(range(256)) - found if negated else frozenset(found)


class Automaton:
    """``classes``: byte to column. ``table``: state and column to state. ``accepts``: state to bits of the rules that end there."""

    def __init__(self, rules: list[str], *, search: bool = True, reverse: bool = False):
        nfa = _Nfa(reverse)
        begin = nfa.state()
        ends: dict[int, int] = {}
        for k, rule in enumerate(rules):
            first = nfa.state()
            nfa.empty[begin].append(first)
            ends[nfa.add(_parser.parse(rule), first, False)] = 1 << k
        self._subsets(nfa, begin, ends, search)
        self._minimise()
        #: Bytes that lead from every state to the start: no match spans them.
        self.resets = (self.table == 0).all(axis=0)[self.classes]
        stuck = (self.table == np.arange(len(self.table))[:, None]).all(axis=1) & (self.accepts == 0)
        #: The state that nothing leads out of, if there is one.
        self.dead = int(np.flatnonzero(stuck)[0]) if stuck.any() else -1
        self._rows: list | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_rows": None}

    @property
    def rows(self) -> list[tuple[list[int], int]]:
        """The table as lists, for single steps: of each state the state after each byte, and what it accepts."""
        if self._rows is None:
            self._rows = list(zip(self.table[:, self.classes].tolist(), self.accepts.tolist(), strict=True))
        return self._rows

    def longest(self, data: bytes, start: int, stop: int) -> int:
        """Where the longest match that begins at ``start`` ends, at most ``stop``; -1 if there is none."""
        rows, dead, state, last = self.rows, self.dead, 0, -1
        for at in range(start, stop):
            state = rows[state][0][data[at]]
            if state == dead:
                break
            if rows[state][1]:
                last = at + 1
        return last

    def longest_back(self, data: bytes, end: int, stop: int) -> int:
        """Of a reversed automaton: where the longest match that ends at ``end`` begins, at least ``stop``; -1 if there is none."""
        rows, dead, state, first = self.rows, self.dead, 0, -1
        for at in range(end - 1, stop - 1, -1):
            state = rows[state][0][data[at]]
            if state == dead:
                break
            if rows[state][1]:
                first = at
        return first

    def _subsets(self, nfa: _Nfa, begin: int, ends: dict[int, int], search: bool) -> None:
        closures = []
        for s in range(len(nfa.moves)):
            seen, todo = {s}, [s]
            while todo:
                for x in nfa.empty[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            closures.append(seen)
        signs: dict[tuple[int, ...], list[int]] = {}
        sets = {bytes_: i for i, bytes_ in enumerate({b for m in nfa.moves for b, _ in m})}
        for byte in range(256):
            signs.setdefault(tuple(i for b, i in sets.items() if byte in b), []).append(byte)
        self.classes = np.zeros(256, dtype=np.uint8)
        members = list(signs.values())
        for k, bytes_ in enumerate(members):
            self.classes[bytes_] = k
        # Of each state with moves, and each class of bytes: the states after it, with empty moves.
        after = [[frozenset().union(*(closures[t] for b, t in m if byte[0] in b)) if any(byte[0] in b for b, t in m) else None for byte in members] for m in nfa.moves]
        live = {s for s, m in enumerate(nfa.moves) if m} | set(ends)
        first = frozenset(closures[begin] & live)
        again = first if search else frozenset()
        number = {first: 0}
        table, todo = [], deque([first])
        while todo:
            states = todo.popleft()
            row = []
            for k in range(len(members)):
                to = again.union(*(x for s in states if (x := after[s][k]) is not None)) & live
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            table.append(row)
        self.table = np.array(table, dtype=np.int32)
        self.accepts = np.array([sum({ends[s] for s in states if s in ends}) for states in number], dtype=np.int64)

    def _minimise(self) -> None:
        """Refine the partition by what is accepted until every block moves to the same blocks."""
        label = np.unique(self.accepts, return_inverse=True)[1].reshape(-1)
        while True:
            finer = np.unique(np.column_stack((label, label[self.table])), axis=0, return_inverse=True)[1].reshape(-1)
            if finer.max() == label.max():
                break
            label = finer
        order, first = np.full(label.max() + 1, -1), []
        for s, x in enumerate(label.tolist()):
            if order[x] < 0:
                order[x] = len(first)
                first.append(s)
        self.table = order[label[self.table[first]]].astype(np.int32)
        self.accepts = self.accepts[first]

    def scan(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every place where a match ends: the text's number, the place in it and the bits of the rules, sorted.

        The texts are cut into lanes at bytes no match spans, and all lanes take a step at a time, so that each byte is looked at
        once, in arrays. The longest few are followed to their ends one by one.
        """
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        whole = b"".join(texts)
        data = np.frombuffer(whole, dtype=np.uint8)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if len(data):
            begins = np.cumsum(lengths) - lengths
            cuts = np.flatnonzero(self.resets[data]) + 1
            at = np.searchsorted(cuts, np.arange(LANE, len(data), LANE))
            starts = np.unique(np.concatenate((begins[lengths > 0], cuts[at[at < len(cuts)]])))
            starts = starts[starts < len(data)]
            sizes = np.diff(np.concatenate((starts, [len(data)])))
            order = np.argsort(-sizes, kind="stable")
            lanes, sizes = starts[order], sizes[order]
            columns = self.classes[data]
            width = self.table.shape[1]
            flat, accepts = (self.table * width).ravel(), np.repeat(self.accepts, width)
            state = np.zeros(len(lanes), dtype=np.int32)
            active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left").tolist()
            step = 0
            for step, n in enumerate(active):
                if n <= FEW:
                    break
                now = flat[state[:n] + columns[lanes[:n] + step]]
                state[:n] = now
                bits = accepts[now]
                if bits.any():
                    hit = np.flatnonzero(bits)
                    found.append((lanes[hit] + step + 1, bits[hit]))
            rows = self.rows
            for lane, size, s in zip(lanes[: active[step]].tolist(), sizes[: active[step]].tolist(), (state[: active[step]] // width).tolist(), strict=True):
                if active[step] > FEW:
                    break
                places, bits = [], []
                for at, byte in enumerate(whole[lane + step : lane + size], lane + step + 1):
                    nexts, _ = rows[s]
                    s = nexts[byte]
                    if rows[s][1]:
                        places.append(at)
                        bits.append(rows[s][1])
                found.append((np.array(places, dtype=np.int64), np.array(bits, dtype=np.int64)))
        ends = np.concatenate([x for x, _ in found]) if found else np.zeros(0, dtype=np.int64)
        bits = np.concatenate([x for _, x in found]) if found else np.zeros(0, dtype=np.int64)
        order = np.argsort(ends)
        ends, bits = ends[order], bits[order]
        past = np.cumsum(lengths)
        text = np.searchsorted(past, ends, side="left")
        return text, ends - (past - lengths)[text] if len(ends) else ends, bits
