"""Secret scanning with one deterministic automaton for all rules."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


@dataclass(frozen=True)
class Rule:
    """Matches are leftmost and don't overlap: ``head``, then the whole run of bytes of the class ``tail`` (if there is one).

    The run needs ``least`` bytes. With ``consumes`` a match whose run is too short is dropped but takes its text, as if
    the rule were head and one or more of the class; without, it doesn't count as a match. A head must not hold another
    whole head of the same rule, and a rule without a head begins at its run.
    """

    kind: str
    head: str = ""
    tail: str = ""
    least: int = 1
    flags: int = 0
    consumes: bool = False

    @property
    def detect(self) -> str:
        """What the automaton looks for: the head and the first byte of the run, or the shortest run if there is no head."""
        return self.head + self.tail if self.head else f"{self.tail}{{{self.least}}}"


_LINK = r"""["']?\x20*[:=]\x20*["']?"""
#: The three base kinds, then the kinds that this method adds, in the order of the output.
BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", r"(?:password|passwd|secret|token|api_?key)" + _LINK, r"[A-Za-z0-9+/_.=-]", 12, re.I, True),
    Rule("access", r"AKIA", r"[A-Z0-9]", 14, 0, True),
    Rule("hex", "", r"[0-9a-f]", 16, 0, True),
    Rule("github", r"gh[pousr]_", r"[A-Za-z0-9]", 20),
    Rule("slack", r"xox[abprs]-", r"[A-Za-z0-9-]", 10),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.", r"[A-Za-z0-9_-]", 8),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
#: Bytes of a segment before the next place where the automaton is surely at its start.
SEGMENT = 512


# ---------------------------------------------------------------- compiling


class _Nfa:
    """Thompson construction over bytes from Python's own parse of a pattern."""

    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.step.append(None)
        return len(self.eps) - 1

    def bytes_of(self, parsed, fold: bool) -> frozenset[int]:
        return self._bytes(*parsed, fold)

    def _bytes(self, op, arg, fold: bool) -> frozenset[int]:
        if op is rc.LITERAL:
            found = {arg}
        elif op is rc.RANGE:
            found = set(range(arg[0], arg[1] + 1))
        elif op is rc.IN:
            found = set().union(*(self._bytes(o, a, fold) for o, a in arg if o is not rc.NEGATE))
            if arg[0][0] is rc.NEGATE:
                found = set(range(256)) - found
        elif op is rc.ANY:
            found = set(range(256)) - {10}
        else:
            raise ValueError(f"rule uses {op}")
        if fold:
            found |= {ord(chr(b).swapcase()) for b in found if b < 128}
        return frozenset(found)

    def add(self, parsed, start: int, fold: bool) -> int:
        """Append the pattern after ``start``; return its last state."""
        for op, arg in parsed:
            if op is rc.SUBPATTERN:
                start = self.add(arg[3], start, fold)
            elif op is rc.BRANCH:
                end = self.state()
                for way in arg[1]:
                    first = self.state()
                    self.eps[start].append(first)
                    self.eps[self.add(way, first, fold)].append(end)
                start = end
            elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
                low, high, body = arg
                for _ in range(low):
                    start = self.add(body, start, fold)
                if high is rc.MAXREPEAT:
                    loop, out = self.state(), self.state()
                    self.eps[start] += [loop, out]
                    self.eps[self.add(body, loop, fold)] += [loop, out]
                    start = out
                else:
                    out = self.state()
                    for _ in range(high - low):
                        first = self.state()
                        self.eps[start] += [first, out]
                        start = self.add(body, first, fold)
                    self.eps[start].append(out)
                    start = out
            else:
                first, end = self.state(), self.state()
                self.eps[start].append(first)
                self.step[first] = (self._bytes(op, arg, fold), end)
                start = end
        return start


@dataclass
class Automaton:
    """``move[state + byte_class[byte]]`` is the next state; states are multiples of the number of byte classes.

    States from ``first_flag`` on have a rule that has just matched: bit r of ``flags[state // n_classes]``. After a byte of
    ``resets`` every state is the start, 0. ``back[r]`` reads a match of rule r backwards and flags its possible begins;
    ``tails[r]`` marks the bytes of the rule's run.
    """

    byte_class: np.ndarray
    n_classes: int
    move: np.ndarray
    flags: np.ndarray
    first_flag: int
    resets: np.ndarray
    back: list[tuple[list[list[int]], list[bool]]]
    tails: list[np.ndarray]

    @property
    def n_states(self) -> int:
        return len(self.flags)


def _subsets(starts: set[int], eps, steps, final: dict[int, int], kinds, again: bool) -> tuple[np.ndarray, np.ndarray]:
    """(moves, flags) by subset construction over byte kinds; ``again`` restarts the search at every byte."""

    def closure(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if steps[s] or s in final)

    start = closure(starts)
    number, queue, rows = {start: 0}, [start], []
    closed: dict[int, frozenset[int]] = {}
    for now in queue:
        reached: list[set[int]] = [set(start) if again else set() for _ in kinds]
        for s in now:
            for allowed, to in steps[s]:
                if to not in closed:
                    closed[to] = closure([to])
                for c in allowed:
                    reached[c] |= closed[to]
        row = []
        for states in map(frozenset, reached):
            if states not in number:
                number[states] = len(queue)
                queue.append(states)
            row.append(number[states])
        rows.append(row)
    flags = np.array([sum({1 << final[s] for s in q if s in final}) for q in queue], np.int64)
    return np.array(rows, np.int64), flags


def _minimised(move: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Moore's partition refinement; the start stays state 0 and states with flags come last."""
    block = np.unique(flags, return_inverse=True)[1]
    while True:
        new = np.unique(np.column_stack([block, block[move]]), axis=0, return_inverse=True)[1].ravel()
        if new.max() == block.max():
            break
        block = new
    first = np.unique(block, return_index=True)[1]
    kind = np.where(flags[first] > 0, 1, 0)
    kind[block[0]] = -1  # no rule matches the empty text, so the start has no flag
    order = np.argsort(kind, kind="stable")
    rank = np.empty(len(first), np.int64)
    rank[order] = np.arange(len(first))
    return rank[block[move[first[order]]]], flags[first[order]]


def compile_rules(rules=RULES) -> Automaton:
    """One automaton that finds every rule's head, and small ones that read a found match backwards to its begin."""
    nfa = _Nfa()
    root = nfa.state()
    ends, firsts = [], []
    for rule in rules:
        first = nfa.state()
        nfa.eps[root].append(first)
        firsts.append(first)
        ends.append(nfa.add(rp.parse(rule.detect, rule.flags), first, bool(rule.flags & re.I)))
    tails = []
    for rule in rules:
        table = np.zeros(256, bool)
        if rule.tail:
            table[sorted(nfa.bytes_of(rp.parse(rule.tail, rule.flags)[0], bool(rule.flags & re.I)))] = True
        tails.append(table)
    sets = sorted({s[0] for s in nfa.step if s}, key=sorted)
    signature = [tuple(b in s for s in sets) for b in range(256)]
    kinds = {k: i for i, k in enumerate(dict.fromkeys(signature))}
    byte_class = np.array([kinds[k] for k in signature], np.int64)
    member = {s: [kinds[k] for k in kinds if k[i]] for i, s in enumerate(sets)}

    steps = [[(member[s[0]], s[1])] if s else [] for s in nfa.step]
    move, flags = _minimised(*_subsets({root}, nfa.eps, steps, {e: r for r, e in enumerate(ends)}, kinds, True))
    n = len(kinds)
    home = (move == 0).all(0)

    turned = [[] for _ in nfa.step]
    eps = [[] for _ in nfa.eps]
    for at, s in enumerate(nfa.step):
        if s:
            turned[s[1]].append((member[s[0]], at))
        for to in nfa.eps[at]:
            eps[to].append(at)
    back = []
    for first, end in zip(firsts, ends):
        m, f = _minimised(*_subsets({end}, eps, turned, {first: 0}, kinds, False))
        back.append((m[:, byte_class].tolist(), (f > 0).tolist()))
    plain = int((flags == 0).sum())
    return Automaton(byte_class, n, (move * n).ravel(), flags, plain * n, np.flatnonzero(home[byte_class]).astype(np.uint8), back, tails)


# ---------------------------------------------------------------- scanning


def _run(auto: Automaton, classes: np.ndarray, at: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lanes, positions, rules as bits) of the hits in lanes of ``size`` bytes from ``at`` on, and the states in which they end.

    All lanes step through the automaton together, the longest first; ``state`` is where each of them begins.
    """
    order = np.argsort(-size, kind="stable")
    begin, left, now = at[order], size[order], state[order].copy()
    active = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), side="left")  # how many are longer than t
    lanes, where, what = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for t, n in enumerate(active.tolist()):
        here = now[:n] = auto.move[now[:n] + classes[begin[:n] + t]]
        hit = np.flatnonzero(here >= auto.first_flag)
        if len(hit):
            lanes.append(order[hit])
            where.append(begin[hit] + t)
            what.append(auto.flags[here[hit] // auto.n_classes])
    last = np.empty_like(now)
    last[order] = now
    return np.concatenate(lanes), np.concatenate(where), np.concatenate(what), last


def hits_of(auto: Automaton, data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, rules as bits), ascending: the bytes at which a rule's head and first byte of its run end.

    One pass over all bytes, in lanes. A lane begins at a document's start or after a byte that brings every state back to the
    start, so no head crosses its border. Where no such byte comes for long, lanes are cut anyway and begin at a guess, the
    start state; those whose forerunner ends in another state run again from there, until all guesses are right.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.cumsum(lens) - lens
    is_reset = np.zeros(256, bool)
    is_reset[auto.resets] = True
    after = np.flatnonzero(is_reset[data]) + 1
    picks = np.searchsorted(after, np.arange(0, len(data), SEGMENT))
    cuts = after[picks[picks < len(after)]]
    sure = np.unique(np.concatenate([begins[lens > 0], cuts[cuts < len(data)]]))
    pieces = -(-np.diff(np.append(sure, len(data))) // (2 * SEGMENT))
    starts = np.repeat(sure, pieces) + 2 * SEGMENT * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    guessed = ~np.isin(starts, sure)
    size = np.diff(np.append(starts, len(data)))
    classes = auto.byte_class[data]
    begun = np.zeros(len(starts), np.int64)
    lane, position, bits, ended = _run(auto, classes, starts, size, begun)
    while True:
        before = np.where(guessed, np.concatenate([[0], ended[:-1]]), 0)
        wrong = np.flatnonzero(before != begun)
        if not len(wrong):
            break
        begun[wrong] = before[wrong]
        stay = ~np.isin(lane, wrong)
        again, at, what, ended[wrong] = _run(auto, classes, starts[wrong], size[wrong], before[wrong])
        lane, position, bits = np.concatenate([lane[stay], wrong[again]]), np.concatenate([position[stay], at]), np.concatenate([bits[stay], what])
    order = np.argsort(position, kind="stable")
    return position[order], bits[order]


def _begin(back: tuple[list[list[int]], list[bool]], doc: bytes, at: int, floor: int) -> int:
    """The leftmost begin, not before ``floor``, of a match whose head ends at ``at``; -1 if there is none."""
    move, accept = back
    state, found = 0, -1
    while at >= floor:
        state = move[state][doc[at]]
        if accept[state]:
            found = at
        elif move[state] == [state] * 256:  # nothing longer can match
            break
        at -= 1
    return found


def _run_end(table: np.ndarray, doc: np.ndarray, at: int) -> int:
    """The first position from ``at`` on whose byte is not in the class."""
    step = 64
    while at < len(doc):
        out = np.flatnonzero(~table[doc[at : at + step]])
        if len(out):
            return at + int(out[0])
        at, step = min(at + step, len(doc)), step * 4
    return at


def spans_of(auto: Automaton, texts: list[str | None], rules=RULES) -> list[list[tuple[int, int, int]]]:
    """For each text its (start, rule, end) in code points, ends exclusive, sorted by start and rule."""
    docs = [(t or "").encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"".join(docs), np.uint8)
    lens = np.array([len(d) for d in docs], np.int64)
    found: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    position, bits = hits_of(auto, data, lens)
    begins = np.cumsum(lens) - lens
    owner = np.searchsorted(begins + lens, position, side="right")
    floor: dict[tuple[int, int], int] = {}
    for at, bit, k in zip((position - begins[owner]).tolist() if len(owner) else [], bits.tolist(), owner.tolist()):
        for r, rule in enumerate(rules):
            if not bit >> r & 1 or at < (low := floor.get((k, r), 0)):
                continue
            begin = _begin(auto.back[r], docs[k], at, low)
            if begin < 0:
                continue
            end = _run_end(auto.tails[r], data[begins[k] : begins[k] + lens[k]], at + 1)
            whole = end - (at if rule.head else begin) >= rule.least or not rule.tail
            if whole:
                found[k].append((begin, r, end))
            if whole or rule.consumes:
                floor[k, r] = end
    for k, spans in enumerate(found):
        if spans:
            lead = np.cumsum((np.frombuffer(docs[k], np.uint8) & 0xC0) != 0x80)
            point = lambda at, lead=lead: int(lead[at - 1]) if at else 0
            found[k] = sorted((point(a), r, point(b)) for a, r, b in spans)
    return found


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` plus ``found``: an array of (kind, start, end), by start and then in the order of the rules.

    * null or empty text: an empty array; very long texts are scanned whole; empty table: no rows;
    * repeated rows get equal rows; overlapping spans of different kinds are all given;
    * an input column named ``found`` is replaced.
    """
    auto = compile_rules(rules)
    kinds = [r.kind for r in rules]

    def scanned(text: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(text), 1024):
            for spans in spans_of(auto, list(text.iloc[at : at + 1024]), rules):
                out.append([{"kind": kinds[k], "start": a, "end": b} for a, k, b in spans])
        return pd.Series(out, dtype="object")

    own = [c for c in docs.columns if c != "found"]
    udf = pandas_udf(scanned, "array<struct<kind:string,start:bigint,end:bigint>>")
    return docs.select(*[F.col(f"`{c}`") for c in own], udf("text").alias("found"))


def op7_automaton_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return d.select("doc_id", *counts, F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("found")).alias("spans"))
