"""Secrets by one combined deterministic automaton.

All rules become one minimal automaton that searches for any of them in a single pass over a text's
bytes. Where it accepts a rule, the rule's own anchored automata give the leftmost, longest span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton
from .common import tidied


@dataclass(frozen=True)
class Rule:
    """A span is the head's longest match and then the tail's; it counts if the tail has least_tail bytes.

    A span that is too short still uses up its text. ``base`` rules make the digest. The pass over the
    text looks for the heads, or for the tail where there is no head: counted tails of several rules in
    one automaton would multiply its states.
    """

    kind: str
    head: str
    tail: str
    least_tail: int = 0
    ignore_case: bool = False
    base: bool = False


# The kinds of secrets and their patterns.
RULES = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?", "[A-Za-z0-9+/_.=-]+", 12, True, True),
    Rule("access", "AKIA", "[A-Z0-9]{14,}", base=True),
    Rule("hex", "", "[0-9a-f]{16,}", base=True),
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]{20,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.", "eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+"),
    Rule("pem", "-----BEGIN [A-Z ]*", "PRIVATE KEY-----"),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]{10,}"),
    Rule("stripe", "[sr]k_live_", "[A-Za-z0-9]{10,}"),
)


MARK = 64  # bytes


class Scanner:
    """The compiled rules. Small enough to go to every task."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = Automaton([(r.head or r.tail, r.ignore_case) for r in rules], search=True)
        self.heads = [Automaton([(r.head, r.ignore_case)]) for r in rules]
        self.whole = [Automaton([(r.head + r.tail, r.ignore_case)]) for r in rules]
        starts = [bytes(b for b, c in enumerate(w.classes) if w.step[w.start + c] != w.dead) for w in self.whole]
        self.first = [re.compile(b"[" + re.escape(x) + b"]") for x in starts]  # bytes that a match can start with
        self.table: list[int] | None = None

    def __getstate__(self):
        return self.__dict__ | {"table": None}

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in bytes, sorted: for each rule the leftmost spans that don't overlap."""
        if self.table is None:
            self.table = self.all.step.tolist()
        step, state, accepting = self.table, self.all.start, self.all.accepting
        used, found, at, failed = [0] * len(self.rules), [], 0, set()
        for c in data.translate(self.all.classes):
            state = step[state + c]
            at += 1
            if state >= accepting:
                marks = self.all.marks[state]
                for k in range(len(used)):
                    if marks >> k & 1 and at > used[k]:
                        self._settle(data, k, at, used, found, failed)
        return sorted(found)

    def _settle(self, data: bytes, k: int, seen: int, used: list[int], found: list, failed: set) -> None:
        """Rule k may start before ``seen``: decide every start from where it was last decided."""
        head = self.heads[k]
        start = used[k]
        while maybe := self.first[k].search(data, start, seen):
            start = maybe.start()
            end = self._longest(data, k, start, failed)
            if end <= start:
                start += 1
                continue
            mid = head.longest(data[start:end].translate(head.classes))[0]
            if end - start - mid >= self.rules[k].least_tail:
                found.append((start, k, end))
            start = end
        used[k] = max(start, seen)

    def _longest(self, data: bytes, k: int, start: int, failed: set[tuple[int, int, int]]) -> int:
        """End of rule k's longest match from ``start``, or -1.

        ``failed`` has (rule, place, state) of earlier tries that came to nothing, every MARK bytes: a try that
        meets one of them ends there, so that starts in a long run that fails don't each read all of it.
        """
        whole = self.whole[k]
        step, classes, dead, accepting, state = whole.step, whole.classes, whole.dead, whole.accepting, whole.start
        end, seen, at = -1, [], start
        while at < len(data):
            state = step[state + classes[data[at]]]
            at += 1
            if state == dead:
                break
            if state >= accepting:
                end = at
            elif not at % MARK:
                mark = (k, at, state)
                if mark in failed:
                    break
                seen.append((mark, end))
        failed.update(mark for mark, before in seen if before == end)
        return end


def _digest_rows(scanner: Scanner, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [r.kind for r in scanner.rules]
    base = [r.base for r in scanner.rules]
    schema = scan_schema(scanner.rules)
    for batch in batches:
        columns: list[list] = [[] for _ in schema]
        for data in batch.column(1):
            data = data.as_py() or b""
            spans = scanner.spans(data)
            if spans and not data.isascii():
                spans = [(len(data[:s].decode("utf-8", "replace")), k, len(data[:e].decode("utf-8", "replace"))) for s, k, e in spans]
            named = [f"{kinds[k]}:{s}:{e}" for s, k, e in spans]
            counts = [0] * len(kinds)
            for _, k, _ in spans:
                counts[k] += 1
            own = ",".join(x for x, (_, k, _) in zip(named, spans, strict=True) if base[k])
            row = [*(c for c, b in zip(counts, base, strict=True) if b), hashlib.sha256(own.encode()).hexdigest(), ",".join(named), *(c for c, b in zip(counts, base, strict=True) if not b)]
            for out, value in zip(columns[1:], row, strict=True):
                out.append(value)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns[1:], list(schema)[1:], strict=True))], schema=schema)


def scan_schema(rules: tuple[Rule, ...]) -> pa.Schema:
    counts = {b: [(f"n_{r.kind}", pa.int64()) for r in rules if r.base == b] for b in (True, False)}
    return pa.schema([("row", pa.int64()), *counts[True], ("base_sha256", pa.string()), ("spans", pa.string()), *counts[False]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: the id, n_<kind> for every base rule, base_sha256, spans, and n_<kind> for the other rules.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then by the rules' order.
    A null or empty text has no spans: zero counts, the digest of the empty string, empty ``spans``.
    Null ids pass through, repeated rows are scanned each, an empty table gives none, other columns
    are dropped whatever their names. Texts of any length take one pass in memory of their size.
    """
    scanner = Scanner(rules)
    fields = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in scan_schema(rules))
    keyed = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).cast("binary").alias("data"))
    return keyed.mapInArrow(tidied(lambda batches: _digest_rows(scanner, batches)), fields).withColumnRenamed("row", id_col)
