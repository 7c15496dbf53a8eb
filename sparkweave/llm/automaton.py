"""Regular expressions over bytes to minimal transition arrays.

Supported syntax: literals, ``.``, classes with ranges and ``^``, ``\\d \\w \\s \\xHH`` and
escaped punctuation, groups, ``|``, and the quantifiers ``? * + {m} {m,} {m,n}``.
Non-ASCII literals stand for their UTF-8 bytes; classes hold ASCII only.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable

ALL = (1 << 256) - 1


def _mask(chars: Iterable[int]) -> int:
    out = 0
    for c in chars:
        out |= 1 << c
    return out


DIGIT = _mask(range(48, 58))
WORD = DIGIT | _mask(range(65, 91)) | _mask(range(97, 123)) | 1 << 95
WHITE = _mask([32, *range(9, 14)])


def _folded(mask: int) -> int:
    for c in range(65, 91):
        pair = 1 << c | 1 << (c + 32)
        if mask & pair:
            mask |= pair
    return mask


class _Parser:
    """Recursive descent to a tree of ('set', mask), ('cat', ...), ('alt', ...), ('rep', node, low, high)."""

    def __init__(self, text: str, ignore_case: bool):
        self.text, self.at, self.fold = text, 0, ignore_case

    def parse(self):
        node = self.alternation()
        if self.at < len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} at {self.at} in {self.text!r}")
        return node

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        if self.at >= len(self.text):
            raise ValueError(f"unexpected end of {self.text!r}")
        self.at += 1
        return self.text[self.at - 1]

    def alternation(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("alt", options)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.quantified())
        return ("cat", parts)

    def quantified(self):
        node = self.atom()
        while self.peek() and self.peek() in "?*+{":
            sign = self.take()
            if sign == "{":
                body = ""
                while self.peek() != "}":
                    body += self.take()
                self.take()
                low, _, high = body.partition(",")
                bounds = (int(low), int(high) if high else (None if "," in body else int(low)))
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[sign]
            node = ("rep", node, *bounds)
        return node

    def atom(self):
        c = self.take()
        if c == "(":
            if self.text.startswith("?:", self.at):
                self.at += 2
            node = self.alternation()
            if self.take() != ")":
                raise ValueError(f"unclosed group in {self.text!r}")
            return node
        if c == "[":
            return ("set", self.char_class())
        if c == ".":
            return ("set", ALL & ~(1 << 10))
        if c == "\\":
            return ("set", self.seen(self.escape()))
        if ord(c) > 127:
            return ("cat", [("set", 1 << b) for b in c.encode()])
        return ("set", self.seen(1 << ord(c)))

    def seen(self, mask: int) -> int:
        return _folded(mask) if self.fold else mask

    def escape(self) -> int:
        c = self.take()
        if c == "x":
            return 1 << int(self.take() + self.take(), 16)
        known = {"d": DIGIT, "w": WORD, "s": WHITE, "n": 1 << 10, "t": 1 << 9, "r": 1 << 13}
        if c in known:
            return known[c]
        if c.isalnum():
            raise ValueError(f"unsupported escape \\{c}")
        return 1 << ord(c)

    def char_class(self) -> int:
        negated, mask, first = False, 0, True
        if self.peek() == "^":
            self.take()
            negated = True
        while first or self.peek() != "]":
            first = False
            c = self.take()
            one = self.escape() if c == "\\" else 1 << ord(c)
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] not in ("]", "") and one.bit_count() == 1:
                self.take()
                d = self.take()
                last = self.escape() if d == "\\" else 1 << ord(d)
                one = _mask(range(one.bit_length() - 1, last.bit_length()))
            mask |= one
        self.take()
        mask = self.seen(mask)
        return ALL & ~mask if negated else mask


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.arcs: list[tuple[int, int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.arcs.append(None)
        return len(self.free) - 1

    def add(self, node, start: int) -> int:
        """Lay the tree down from a state; the state it ends in."""
        kind = node[0]
        if kind == "set":
            end, step = self.state(), self.state()
            self.free[start].append(step)
            self.arcs[step] = (node[1], end)
            return end
        if kind == "cat":
            for part in node[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in node[1]:
                self.free[self.add(part, start)].append(end)
            return end
        _, part, low, high = node
        for _ in range(low):
            start = self.add(part, start)
        if high is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(part, loop)].append(loop)
            return loop
        end = self.state()
        self.free[start].append(end)
        for _ in range(high - low):
            start = self.add(part, start)
            self.free[start].append(end)
        return end

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        found, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in found:
                found.add(s)
                todo += self.free[s]
        return frozenset(found)


class Automaton:
    """Transition arrays over byte classes.

    ``classes`` maps bytes to class numbers, for ``bytes.translate``. ``step[state + class]`` is the
    next state, states being offsets of rows. States from ``accepting`` on accept the patterns in the
    bits of ``marks[state]``; from ``dead`` (or -1) nothing more can match.
    """

    def __init__(self, patterns: list[tuple[str, bool]], search: bool = False, most_states: int = 20_000):
        nfa = _Nfa()
        start, ends = nfa.state(), {}
        for bit, (pattern, ignore_case) in enumerate(patterns):
            ends[nfa.add(_Parser(pattern, ignore_case).parse(), start)] = 1 << bit
        if search:  # any byte may come before a match
            anything, step = nfa.state(), nfa.state()
            nfa.free[anything] += [step, start]
            nfa.arcs[step] = (ALL, anything)
            start = anything
        masks = sorted({a[0] for a in nfa.arcs if a})
        kinds: dict[tuple, int] = {}
        classes = [kinds.setdefault(tuple(m >> b & 1 for m in masks), len(kinds)) for b in range(256)]
        member = [classes.index(k) for k in range(len(kinds))]
        table, marks = self._subsets(nfa, start, ends, member, most_states)
        table, marks = self._minimal(table, marks)
        width = 1 << max(1, (len(kinds) - 1).bit_length())
        order = sorted(range(len(table)), key=lambda s: (marks[s] > 0, s != 0, s))  # the start comes first, unless it accepts
        place = {s: i * width for i, s in enumerate(order)}
        self.classes, self.width = bytes(classes), width
        self.start = place[0]
        self.step = array("i", bytes(4 * width * len(table)))
        for s in order:
            for k, to in enumerate(table[s]):
                self.step[place[s] + k] = place[to]
        self.accepting = width * sum(m == 0 for m in marks)
        self.marks = {place[s]: marks[s] for s in order if marks[s]}
        dead = [s for s in order if not marks[s] and all(to == s for to in table[s])]
        self.dead = place[dead[0]] if dead else -1

    @staticmethod
    def _subsets(nfa: _Nfa, start: int, ends: dict[int, int], member: list[int], most: int):
        first = nfa.closure([start])
        numbers, todo, table, marks = {first: 0}, [first], [], []
        closures: dict[frozenset[int], frozenset[int]] = {}
        while todo:
            now = todo.pop(0)
            if len(numbers) > most:
                raise ValueError(f"the rules need more than {most} states; shorten counted repeats")
            marks.append(sum(ends[s] for s in now if s in ends))
            arcs, row = [nfa.arcs[s] for s in now if nfa.arcs[s]], []
            for byte in member:
                reached = frozenset(to for mask, to in arcs if mask >> byte & 1)
                if reached not in closures:
                    closures[reached] = nfa.closure(reached)
                after = closures[reached]
                if after not in numbers:
                    numbers[after] = len(numbers)
                    todo.append(after)
                row.append(numbers[after])
            table.append(row)
        return table, marks

    @staticmethod
    def _minimal(table: list[list[int]], marks: list[int]):
        """Moore's refinement: split blocks by their successors' blocks until none splits."""
        block, count = marks, -1
        while True:
            names: dict[tuple, int] = {}
            block = [names.setdefault((block[s], *(block[t] for t in row)), len(names)) for s, row in enumerate(table)]
            if len(names) == count:
                break
            count = len(names)
        seen: dict[int, int] = {}
        for s, b in enumerate(block):
            seen.setdefault(b, s)
        return [[block[t] for t in table[seen[b]]] for b in range(count)], [marks[seen[b]] for b in range(count)]

    @property
    def size(self) -> int:
        return len(self.step) // self.width

    def longest(self, classed: bytes) -> tuple[int, bool]:
        """End of the longest match from the start of these byte classes, or -1; whether more bytes could lengthen it."""
        step, state = self.step, self.start
        found = 0 if state >= self.accepting else -1
        for i, c in enumerate(classed):
            state = step[state + c]
            if state == self.dead:
                return found, False
            if state >= self.accepting:
                found = i + 1
        return found, True
