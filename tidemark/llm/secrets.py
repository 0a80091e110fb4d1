"""Secret scans: all rules in one minimal deterministic automaton, one pass over the bytes.

A rule's regular expression becomes a nondeterministic automaton (positions and their followers).
The reversed automata of all rules run together: subset construction turns them into one
deterministic automaton, which is minimised and laid out as a flat transition array over byte
classes. A text is read once, from its last byte to its first; the state at a byte tells which
rules have a match that starts there. Only from such starts does the rule's own small automaton
walk forward to the longest end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from tidemark.llm.common import any_columns, as_bytes, fresh, map_texts, quoted, without

#: Compiled automata of more states than this are refused: they are sent to every task.
MOST_STATES = 1 << 15

SPAN = "kind string, start bigint, end bigint"

Positions = frozenset[int]


@dataclass(frozen=True)
class Rule:
    """A secret is ``head`` and then ``value`` of ``least`` characters or more.

    Both are regular expressions over bytes: literals, ``\\xNN``, classes, groups, ``|`` and the
    repetitions ``? * + {n} {n,}``. A match is leftmost and longest; matches do not overlap, and
    a match whose value is too short is dropped after it has been passed over. No character may
    both extend the head and begin the value. ``any_case`` lets letters of the head match in
    either case.
    """

    kind: str
    head: str
    value: str
    least: int = 1
    any_case: bool = False


# The rules that the specification gives.
BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""",
        "[A-Za-z0-9+/_.=-]+",
        least=8,
        any_case=True,
    ),
    Rule("access", "AKIA", "[A-Z0-9]+", least=12),
    # Runs of 32 or more: the automaton counts, or else each letter a-f would be a start.
    Rule("hex", "", "[0-9a-f]{32,}"),
)
#: Public formats of further credentials.
MORE_RULES = (
    Rule("pem", "-----BEGIN", "[A-Z ]+PRIVATE KEY-----"),
    Rule("forge", "gh[opsru]_", "[A-Za-z0-9]+", least=36),
    Rule("chat", "xox[abprs]-", "[A-Za-z0-9-]+", least=10),
    Rule("jwt", "eyJ", r"[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=30),
    Rule("login", "[a-z]+://[A-Za-z0-9_.-]+:", "[A-Za-z0-9_.~!-]+@", least=7),
)
RULES = BASE_RULES + MORE_RULES


class Pattern:
    """The positions of a regular expression, and which of them may follow each other.

    ``bytes_at[p]`` are the bytes that position ``p`` reads; ``first`` and ``last`` are the
    positions where a match may begin and end. Position automata have no empty steps, and
    reversing one only swaps its ends and turns its arrows.
    """

    def __init__(self, text: str, any_case: bool = False):
        self.bytes_at: list[frozenset[int]] = []
        self.follow: list[set[int]] = []
        self._text, self._at, self._any_case = text, 0, any_case
        self.empty, self.first, self.last = self._alternatives()
        if self._at < len(text):
            raise ValueError(f"unexpected {text[self._at]!r} at {self._at} of {text!r}")

    def _peek(self) -> str:
        return self._text[self._at : self._at + 1]

    def _next(self) -> str:
        c = self._peek()
        if not c:
            raise ValueError(f"{self._text!r} ends too early")
        self._at += 1
        return c

    def _alternatives(self) -> tuple[bool, Positions, Positions]:
        empty, first, last = self._sequence()
        while self._peek() == "|":
            self._next()
            e, f, z = self._sequence()
            empty, first, last = empty or e, first | f, last | z
        return empty, first, last

    def _sequence(self) -> tuple[bool, Positions, Positions]:
        done: tuple[bool, Positions, Positions] = (True, frozenset(), frozenset())
        while self._peek() and self._peek() not in "|)":
            done = self._joined(done, self._repeated())
        return done

    def _joined(self, a, b) -> tuple[bool, Positions, Positions]:
        for p in a[2]:
            self.follow[p] |= b[1]
        return a[0] and b[0], a[1] | b[1] if a[0] else a[1], a[2] | b[2] if b[0] else b[2]

    def _looped(self, part) -> tuple[bool, Positions, Positions]:
        return self._joined(part, part) and part

    def _repeated(self) -> tuple[bool, Positions, Positions]:
        start = self._at
        part = self._atom()
        end, mark = self._at, self._peek()
        if mark and mark in "?*+":
            self._next()
            if mark != "?":
                part = self._looped(part)
            return (part[0] or mark != "+", *part[1:])
        if mark != "{":
            return part
        close = self._text.index("}", self._at)
        least, more, most = self._text[self._at + 1 : close].partition(",")
        if most:
            raise ValueError("a repetition has no upper bound other than its lower one")
        # Each copy of the part is parsed again and so has positions of its own.
        done = part
        for _ in range(int(least) - 1):
            self._at = start
            part = self._atom()
            done = self._joined(done, part)
        if more:
            self._looped(part)
        self._at = close + 1
        assert end <= close
        return done

    def _atom(self) -> tuple[bool, Positions, Positions]:
        c = self._next()
        if c == "(":
            inner = self._alternatives()
            if self._next() != ")":
                raise ValueError(f"a group of {self._text!r} is not closed")
            return inner
        if c == "[":
            return self._position(self._class())
        if c in "?*+{":
            raise ValueError(f"nothing to repeat at {self._at - 1} of {self._text!r}")
        return self._position({self._character(c)})

    def _character(self, c: str) -> int:
        if c == "\\":
            c = self._next()
            if c == "x":
                return int(self._next() + self._next(), 16)
        if ord(c) > 127:
            raise ValueError("patterns are ASCII")
        return ord(c)

    def _class(self) -> set[int]:
        found: set[int] = set()
        while (c := self._next()) != "]":
            low = self._character(c)
            ranged = self._peek() == "-" and self._text[self._at + 1 : self._at + 2] != "]"
            if ranged:
                self._next()
            found.update(range(low, (self._character(self._next()) if ranged else low) + 1))
        return found

    def _position(self, members: set[int]) -> tuple[bool, Positions, Positions]:
        if self._any_case:
            letters = [c for c in members if chr(c).isalpha()]
            members = members | {c ^ 32 for c in letters}
        self.bytes_at.append(frozenset(members))
        self.follow.append(set())
        here = frozenset([len(self.follow) - 1])
        return False, here, here


def pattern(rule: Rule) -> Pattern:
    """Head and value of a rule in one pattern."""
    head, value = Pattern(rule.head, rule.any_case), Pattern(rule.value)
    shift = len(head.follow)
    moved = lambda ps: frozenset(p + shift for p in ps)
    head.bytes_at += value.bytes_at
    head.follow += [set(moved(f)) for f in value.follow]
    head.empty, head.first, head.last = head._joined(
        (head.empty, head.first, head.last), (value.empty, moved(value.first), moved(value.last))
    )
    if head.empty:
        raise ValueError(f"rule {rule.kind!r} matches nothing at all")
    return head


@dataclass(frozen=True)
class Automaton:
    """A complete deterministic automaton over byte classes.

    ``steps[state * width + class]`` is the next state times ``width``. States are numbered so
    that those from ``accepting`` on accept; ``rules[state // width]`` has a bit for each rule.
    """

    classes: bytes
    width: int
    steps: list[int]
    start: int
    accepting: int
    rules: list[int]

    @property
    def states(self) -> int:
        return len(self.rules)


def byte_classes(sets: list[frozenset[int]]) -> tuple[bytes, list[int]]:
    """The class of each byte, and one byte of each class: bytes that no set tells apart."""
    members = np.zeros((256, len(sets)), bool)
    for i, s in enumerate(sets):
        members[list(s), i] = True
    _, first, classes = np.unique(members, axis=0, return_index=True, return_inverse=True)
    return bytes(classes.ravel().tolist()), first.tolist()


def determinise(
    begin: Positions, step: Callable[[Positions, int], Positions], classes: list[int]
) -> tuple[list[Positions], np.ndarray]:
    """Subset construction: the sets of positions that can be reached, and the step between them."""
    found, order, rows = {begin: 0}, [begin], []
    for held in order:
        row = []
        for byte in classes:
            to = step(held, byte)
            if to not in found:
                if len(order) == MOST_STATES:
                    raise ValueError(f"the rules need more than {MOST_STATES} states")
                found[to] = len(order)
                order.append(to)
            row.append(found[to])
        rows.append(row)
    return order, np.array(rows, np.int64)


def minimise(steps: np.ndarray, colours: np.ndarray) -> np.ndarray:
    """The block of each state: split by colour, then by successors' blocks until nothing splits."""
    blocks = np.unique(colours, return_inverse=True)[1].ravel()
    while True:
        signature = np.column_stack([blocks, blocks[steps]])
        finer = np.unique(signature, axis=0, return_inverse=True)[1].ravel()
        if finer.max() == blocks.max():
            return finer
        blocks = finer


def _automaton(
    begin: Positions,
    step: Callable[[Positions, int], Positions],
    accepts: Callable[[Positions], int],
    sets: list[frozenset[int]],
) -> Automaton:
    classes, samples = byte_classes(sets)
    order, steps = determinise(begin, step, samples)
    colours = np.array([accepts(s) for s in order], np.int64)
    blocks = minimise(steps, colours)
    n, width = int(blocks.max()) + 1, len(samples)
    member = np.zeros(n, np.int64)
    member[blocks] = np.arange(len(blocks))
    # Accepting states last: the scan then needs one comparison for each byte.
    number = np.argsort(np.argsort(colours[member] != 0, kind="stable"), kind="stable")
    member = member[np.argsort(number)]
    return Automaton(
        classes,
        width,
        (number[blocks[steps[member]]] * width).ravel().tolist(),
        int(number[blocks[0]]) * width,
        int((colours[member] == 0).sum()) * width,
        colours[member].tolist(),
    )


def start_finder(patterns: list[Pattern]) -> Automaton:
    """Reads a text backwards; after a byte, ``rules`` tells whose matches start with it."""
    shifts = np.cumsum([0, *[len(p.follow) for p in patterns]]).tolist()
    sets = [s for p in patterns for s in p.bytes_at]
    before: list[set[int]] = [set() for _ in sets]
    ends, owner_of_first = set(), {}
    for i, (p, shift) in enumerate(zip(patterns, shifts, strict=False)):
        ends |= {q + shift for q in p.last}
        owner_of_first |= {q + shift: i for q in p.first}
        for q, followers in enumerate(p.follow):
            for r in followers:
                before[r + shift].add(q + shift)

    def step(held: Positions, byte: int) -> Positions:
        # A match may end at any byte, so the last positions are always among the candidates.
        may = ends.union(*[before[q] for q in held])
        return frozenset(q for q in may if byte in sets[q])

    def accepts(held: Positions) -> int:
        bits = 0
        for q in held:
            if q in owner_of_first:
                bits |= 1 << owner_of_first[q]
        return bits

    return _automaton(frozenset(), step, accepts, sets)


def walker(p: Pattern) -> Automaton:
    """Reads on from a start; accepts wherever a match may end."""
    begin = -1  # before the first byte

    def step(held: Positions, byte: int) -> Positions:
        may = set().union(*[p.first if q == begin else p.follow[q] for q in held])
        return frozenset(q for q in may if byte in p.bytes_at[q])

    def accepts(held: Positions) -> int:
        return int(bool(held & p.last) or (p.empty and begin in held))

    return _automaton(frozenset([begin]), step, accepts, p.bytes_at)


def longest(a: Automaton, data: bytes, start: int) -> int:
    """Where the longest match from ``start`` ends; -1 if none does."""
    classes, steps, accepting, state = a.classes, a.steps, a.accepting, a.start
    dead = _dead(a)
    end = start if state >= accepting else -1
    for at in range(start, len(data)):
        state = steps[state + classes[data[at]]]
        if state >= accepting:
            end = at + 1
        elif state == dead:
            break
    return end


def _dead(a: Automaton) -> int:
    """The state that nothing leaves and that does not accept; -1 if there is none."""
    for s in range(0, a.accepting, a.width):
        if all(t == s for t in a.steps[s : s + a.width]):
            return s
    return -1


class Scanner:
    """All rules, compiled."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        patterns = [pattern(r) for r in rules]
        self.starts = start_finder(patterns)
        self.walkers = [walker(p) for p in patterns]
        self.heads = [walker(Pattern(r.head, r.any_case)) for r in rules]

    def hits(self, data: bytes) -> list[tuple[int, int]]:
        """Ascending positions where matches may start, with the bits of their rules."""
        a = self.starts
        steps, accepting, state, width = a.steps, a.accepting, a.start, a.width
        found, at = [], len(data)
        for c in data.translate(a.classes)[::-1]:
            at -= 1
            state = steps[state + c]
            if state >= accepting:
                found.append((at, a.rules[state // width]))
        found.reverse()
        return found

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """``start, end, rule`` of the secrets, in bytes, by start and then rule."""
        free = [0] * len(self.rules)
        found = []
        for start, bits in self.hits(data):
            for i, rule in enumerate(self.rules):
                if not bits >> i & 1 or start < free[i]:
                    continue
                end = longest(self.walkers[i], data, start)
                free[i] = end
                if end - longest(self.heads[i], data, start) >= rule.least:
                    found.append((start, end, i))
        return found


@cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """The compiled rules; a Python worker compiles them once."""
    return Scanner(rules)


def in_code_points(data: bytes, offsets: list[int]) -> dict[int, int]:
    """Code points before each byte offset."""
    out, before, count = {}, 0, 0
    for o in sorted(set(offsets)):
        count += len(data[before:o].decode())
        before = o
        out[o] = count
    return out


@any_columns
def find_secrets(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text"
) -> DataFrame:
    """The input's columns and ``secrets``: an array of ``kind, start, end``.

    Spans are counted in code points, ``end`` exclusive, ordered by start and then by the order
    of the rules. Matches of one rule do not overlap; those of different rules may. An input
    column named ``secrets`` is replaced.

    Null and empty texts have no secrets. Each row is scanned by itself, so repeated rows have
    equal results, whatever their other columns hold, and an empty table gives an empty table.
    """
    scanner(rules)  # errors in rules show here, not in the tasks
    docs = without(docs, "secrets")
    (found_col,) = fresh(docs, "found")
    names = docs.columns
    at = names.index(text_col)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        compiled = scanner(rules)
        kinds, starts, ends, rows = [], [], [], [0]
        for data in as_bytes(batch.column(at)):
            spans = compiled.spans(data) if data else []
            place = in_code_points(data, [x for s in spans for x in s[:2]]) if spans else {}
            kinds += [rules[i].kind for _, _, i in spans]
            starts += [place[s] for s, _, _ in spans]
            ends += [place[e] for _, e, _ in spans]
            rows.append(len(kinds))
        structs = pa.StructArray.from_arrays(
            [pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
            names=["kind", "start", "end"],
        )
        secrets = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), structs)
        return pa.record_batch([*batch.columns, secrets], names=[*names, found_col])

    added = StructField(found_col, ArrayType(StructType.fromDDL(SPAN)))
    schema = StructType([*docs.schema.fields, added])
    return map_texts(docs, text_col, scan, schema).withColumnRenamed(found_col, "secrets")


def joined_spans(secrets: F.Column) -> F.Column:
    """``kind:start:end`` of an array of secrets, comma-joined."""
    return F.array_join(
        F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def secret_report(found: DataFrame, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Columns of ``found`` and a count ``n_<kind>`` for each base rule, ``base_sha256``, ``spans``."""
    of = lambda kinds: F.filter("secrets", lambda s: s["kind"].isin(kinds))
    kinds = [r.kind for r in base]
    return without(found, *[f"n_{k}" for k in kinds], "base_sha256", "spans").select(
        "*",
        *[F.size(of([k])).cast("bigint").alias(f"n_{k}") for k in kinds],
        F.sha2(joined_spans(of(kinds)), 256).alias("base_sha256"),
        joined_spans(F.col("secrets")).alias("spans"),
    )
