"""Secret scans: all rules in one automaton, one pass over the bytes of each text.

Each rule is a regular expression of a small language. All of them are compiled together: Thompson's construction, subset
construction over classes of bytes, refinement to the least automaton, and rows of transitions. The one pass over a text's
UTF-8 bytes gives every rule's spans, leftmost first, without overlap, each as long as it can be.

A deterministic state knows, for each rule, the threads that live and how long ago each began, as long as that is the same
for all ways to the state. A thread that comes to a loop, or to an end, has its start put into the rule's register; one that has
come to an end drops all that began later, and gives its span when it can go no further. What is to be put or given belongs to the
state entered, so that most bytes of a text cost one look-up. The compiler raises for rules that would need
more: a second register, an older thread beside one that has ended, or an end that can be passed without another.

Null and empty texts hold no secret. Texts are scanned whole. Positions are code points, as bytes are only counted up to a span that is
found. Extra columns do no harm. A repeated document gives a repeated row, one without an id a row with a null id. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import in_pieces, table


@dataclass(frozen=True)
class Rule:
    """Spans of ``pattern``, but for those whose bytes from the first possible end on are fewer than ``least``.

    ``edge``: a class of characters that must not stand before a span (empty: any may).
    """

    kind: str
    pattern: str
    least: int = 1
    edge: str = ""


_WORDS = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
_INSIDE = "[A-Za-z0-9_.-]"

#: The three base kinds, then kinds of keys with published formats. Least lengths are those of the
#: pattern's last run: group 2 of 6 characters, 20 characters with ``AKIA``, 24 with the first seven.
RULES = (
    Rule("assign", _WORDS + "[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]+", 6),
    Rule("access", "AKIA[A-Z0-9]+", 16),
    Rule("hex", "[0-9a-f]{8}[0-9a-f]*", 17),
    Rule("private_key", "-----BEGIN\\x20([A-Z]+\\x20)*PRIVATE\\x20KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 36, _INSIDE),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 10, _INSIDE),
    Rule("google", "AIza[A-Za-z0-9_-]+", 35, _INSIDE),
    Rule("stripe", "[sr]k_live_[A-Za-z0-9]+", 20, _INSIDE),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 8, _INSIDE),
)


class _Parser:
    """Literals, ``\\xHH``, classes, groups, ``|``, ``? * + {n}``; builds an NFA of bytes."""

    def __init__(self, text: str, moves: list[dict[int, frozenset[int]]], free: list[set[int]]):
        self.s, self.i, self.moves, self.free = text, 0, moves, free

    def state(self) -> int:
        self.moves.append({})
        self.free.append(set())
        return len(self.moves) - 1

    def parse(self) -> tuple[int, int]:
        a, b = self.either()
        if self.i != len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} in rule {self.s!r}")
        return a, b

    def either(self) -> tuple[int, int]:
        arms = [self.row()]
        while self.i < len(self.s) and self.s[self.i] == "|":
            self.i += 1
            arms.append(self.row())
        a, b = self.state(), self.state()
        for x, y in arms:
            self.free[a].add(x)
            self.free[y].add(b)
        return a, b

    def row(self) -> tuple[int, int]:
        a = b = self.state()
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            x, y = self.times()
            self.free[b].add(x)
            b = y
        return a, b

    def times(self) -> tuple[int, int]:
        begin = self.i
        a, b = self.one()
        end, n = self.i, self.s[self.i : self.i + 1]
        if n and n in "?*+":
            self.i += 1
            if n in "*+":
                self.free[b].add(a)
            if n in "?*":
                x, y = self.state(), self.state()
                self.free[x] |= {a, y}
                self.free[b].add(y)
                return x, y
        elif m := re.compile(r"\{(\d+)\}").match(self.s, self.i):
            for _ in range(int(m[1]) - 1):
                self.i = begin
                x, y = self.one()
                assert self.i == end
                self.free[b].add(x)
                b = y
            self.i = m.end()
        return a, b

    def char(self) -> int:
        c = self.s[self.i]
        if c != "\\":
            self.i += 1
            return ord(c)
        if self.s[self.i + 1] == "x":
            self.i += 4
            return int(self.s[self.i - 2 : self.i], 16)
        self.i += 2
        return ord(self.s[self.i - 1])

    def over(self) -> frozenset[int]:
        self.i += 1
        out: set[int] = set()
        while self.s[self.i] != "]":
            low = self.char()
            if self.s[self.i] == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                out |= set(range(low, self.char() + 1))
            else:
                out.add(low)
        self.i += 1
        return frozenset(out)

    def one(self) -> tuple[int, int]:
        if self.s[self.i] == "(":
            self.i += 1
            a, b = self.either()
            self.i += 1
            return a, b
        over = self.over() if self.s[self.i] == "[" else frozenset([self.char()])
        a, b = self.state(), self.state()
        self.moves[a][b] = over
        return a, b


#: What is done on entering a state, at byte ``i``: rules whose span ends before ``i``; (rule, k): its start is ``i + 1 - k``; rules of which ``i`` is the first byte that may end a span.
Act = tuple[tuple[int, ...], tuple[tuple[int, int], ...], tuple[int, ...]]
_NOTHING: Act = ((), (), ())


@dataclass(frozen=True)
class Automaton:
    """``move[s, byte]`` is the next state, ``act[s]`` what is done there, ``open[s]`` the rules that have a span if the text ends there."""

    move: np.ndarray
    act: list[Act]
    open: list[tuple[int, ...]]


class _Thread:
    """One rule's nondeterministic automaton and its live threads: sets of (state, age), age 0 once the start is in the register."""

    def __init__(self, rule: Rule):
        self.moves: list[dict[int, frozenset[int]]] = []
        self.free: list[set[int]] = []
        self.rule = rule
        self.enter, self.accept = _Parser(rule.pattern, self.moves, self.free).parse()
        self.edge = _Parser(rule.edge, [], []).over() if rule.edge else frozenset()
        self.reach = [self._reach(x) for x in range(len(self.moves))]
        after = [{z for y in m for z in self.reach[y]} for m in self.moves]
        self.loops = {x for x in range(len(self.moves)) if self._again(x, after)}

    def _reach(self, x: int) -> frozenset[int]:
        todo, seen = [x], {x}
        while todo:
            for y in self.free[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return frozenset(y for y in seen if self.moves[y] or y == self.accept)

    @staticmethod
    def _again(x: int, after: list[set[int]]) -> bool:
        """Whether ``x`` can be reached from itself over at least one byte."""
        todo, seen = list(after[x]), set(after[x])
        while todo:
            now = todo.pop()
            if now == x:
                return True
            for y in after[now] - seen:
                seen.add(y)
                todo.append(y)
        return False

    def step(self, live: frozenset, ended: bool, free: bool, c: int) -> tuple[frozenset, bool, bool, int | None, bool]:
        """From live threads, over byte ``c``: the threads, whether one has ended, whether a span ended before ``c``,
        how many bytes ago the register's new start was (None: none), and whether this is its first end.
        """
        ends = False
        if ended:
            now = self._over(live, c)
            if now:
                if not any(x == self.accept for x, _ in now):
                    raise ValueError(f"rule {self.rule.kind}: an end can be passed without another")
                return now, True, False, None, False
            ends = True
            live = frozenset()
        if free:
            live |= {(x, 0.5) for x in self.reach[self.enter]}
        now, put, first = self._over(live, c), None, False
        if any(x == self.accept for x, _ in now):
            oldest = min((a for _, a in now), key=lambda a: -1e9 if a == 0 else -a)
            mine = {a for x, a in now if x == self.accept}
            if mine != {oldest}:
                raise ValueError(f"rule {self.rule.kind}: an older thread lives beside one that has ended")
            now = frozenset((x, a) for x, a in now if a == oldest)
            first = True
        looped = {a for x, a in now if a and (x in self.loops or first)}
        if looped:
            if len(looped) > 1 or any(a == 0 or a > max(looped) for _, a in now):
                raise ValueError(f"rule {self.rule.kind}: two threads need the register")
            put = int(max(looped))
            now = frozenset((x, 0 if a == put else a) for x, a in now)
        return now, first, ends, put, first

    def _over(self, live: frozenset, c: int) -> frozenset:
        """The threads after ``c``; of two in one state the one that began earlier stays."""
        best: dict[int, float] = {}
        for x, a in live:
            for y, over in self.moves[x].items():
                if c in over:
                    age = 0 if a == 0 else 1 if a == 0.5 else a + 1
                    for z in self.reach[y]:
                        if z not in best or age == 0 or best[z] and age > best[z]:
                            best[z] = age
        return frozenset(best.items())


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Automaton:
    """The least deterministic automaton that gives all rules' spans."""
    threads = [_Thread(r) for r in rules]
    # classes of bytes that no rule tells apart
    sets = sorted({s for t in threads for m in t.moves for s in m.values()} | {t.edge for t in threads}, key=sorted)
    kind: dict[tuple[bool, ...], int] = {}
    of_byte = np.array([kind.setdefault(tuple(c in s for s in sets), len(kind)) for c in range(256)])
    shown = [int(np.flatnonzero(of_byte == k)[0]) for k in range(len(kind))]

    nothing = (frozenset(), False, True)
    first = (tuple(nothing for _ in threads), _NOTHING)
    number, rows, todo, known = {first: 0}, [], [first], {}
    while todo:
        parts, _ = todo.pop(0)
        row = []
        for c in shown:
            new, ends, puts, firsts = [], [], [], []
            for k, (t, part) in enumerate(zip(threads, parts, strict=True)):
                if (k, part, c) not in known:
                    known[k, part, c] = t.step(*part, c)
                live, ended, gives, put, begins = known[k, part, c]
                new.append((live, ended, c not in t.edge))
                ends += [k] * gives
                puts += [] if put is None else [(k, put)]
                firsts += [k] * begins
            to = (tuple(new), (tuple(ends), tuple(puts), tuple(firsts)))
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        rows.append(row)
    act = [a for _, a in number]
    open_ = [tuple(k for k, (_, ended, _) in enumerate(parts) if ended) for parts, _ in number]

    # refinement until no two states of a block differ
    move, of = np.array(rows), np.array(_numbered(zip(act, open_, strict=True)))
    while True:
        new = np.unique(np.column_stack([of, of[move]]), axis=0, return_inverse=True)[1].ravel()
        if new.max() == of.max():
            break
        of = new
    _, keep = np.unique(of, return_index=True)
    order = np.sort(keep)  # the start state's block comes first
    name = np.empty(len(order), np.int64)
    name[of[order]] = np.arange(len(order))
    return Automaton(name[of[move[order]]][:, of_byte].astype(np.int32), [act[s] for s in order], [open_[s] for s in order])


def _numbered(values) -> list[int]:
    seen: dict = {}
    return [seen.setdefault(v, len(seen)) for v in values]


def linked(automaton: Automaton) -> list[list]:
    """The transition rows as lists that refer to one another: a step is one index. Entry 256 is what is done there (None: nothing), 257 the rules open at an end."""
    rows: list[list] = [[None] * 258 for _ in automaton.act]
    for s, to in enumerate(automaton.move.tolist()):
        rows[s][:256] = [rows[t] for t in to]
        rows[s][256] = automaton.act[s] if automaton.act[s] != _NOTHING else None
        rows[s][257] = automaton.open[s]
    return rows


def spans_of(data: bytes, rows: list[list], least: list[int]) -> list[tuple[int, int, int]]:
    """(start, rule number, end) of all spans, in bytes, by start, then rule: one pass from left to right."""
    row, out, start, first = rows[0], [], [0] * len(least), [0] * len(least)
    for i, c in enumerate(data):
        row = row[c]
        if row[256]:
            ends, puts, firsts = row[256]
            for k in ends:
                if i - first[k] >= least[k]:
                    out.append((start[k], k, i))
            for k, back in puts:
                start[k] = i + 1 - back
            for k in firsts:
                first[k] = i
    out += [(start[k], k, len(data)) for k in row[257] if len(data) - first[k] >= least[k]]
    return sorted(out)


def in_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of bytes as spans of code points."""
    if not spans or data.isascii():
        return spans
    before = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    return [(int(before[a]), k, int(before[b])) for a, k, b in spans]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every document with its spans: ``id_col``, ``found array<struct<kind, start, end>>``, by start, then rule."""
    automaton = compile_rules(rules)
    least, kinds = [r.least for r in rules], [r.kind for r in rules]
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = linked(automaton)
        for part in in_pieces(parts):
            out = []
            for t in part.column("_t").to_pylist():
                data = t.encode("utf-8", "surrogatepass") if t else b""
                out.append([{"kind": kinds[k], "start": a, "end": b} for a, k, b in in_code_points(data, spans_of(data, rows, least))])
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(out, spans)], ["_id", "found"])

    kept = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"))
    return kept.mapInArrow(run, "_id long, found array<struct<kind:string,start:int,end:int>>").withColumnRenamed("_id", id_col)


def _joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digested(found: DataFrame) -> DataFrame:
    """Of ``scan``'s rows: ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` and ``spans``."""
    base = [r.kind for r in RULES[:3]]

    def count(kind: str):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(_joined(F.filter("found", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
    )


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts, digest of the base spans, and all spans. Null and empty texts have none (an empty
    string's digest); repeated rows and null ids stay; columns beside ``doc_id`` and ``text`` are ignored; an empty table gives no rows.
    """
    return digested(scan(table(spark, sf_dir, "documents")))
