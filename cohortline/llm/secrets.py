"""Secret scans by grammar inference.

Three fixed patterns give the base spans. Their values, a bounded sample, are the labelled credentials from which a
probabilistic automaton is inferred for each kind: a prefix tree whose statistically compatible states are merged. All
other candidates, runs of credential characters at any place of any text, are scored by how much likelier an automaton
makes them than a model of ordinary runs does; those above a fixed level are added as spans, and so are runs that hold
an access or hex base span and letters or digits beside it."""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import held, pick, rows_to, saved, table

KINDS = ("assign", "access", "hex")
#: Values of each kind, and ordinary candidates, that the automata are inferred from at most.
SAMPLE_VALUES = 400
SAMPLE_ORDINARY = 4000
#: A kind with fewer values in the sample gets no automaton.
MIN_VALUES = 10
#: Characters of a value or candidate that a sample keeps at most; longer ones aren't in the samples, but are scored.
SAMPLE_CHARS = 200
#: Log odds above which a candidate is a credential: of strings that the ordinary model makes, one in a million at most.
LEVEL = math.log(1e6)
#: Weight of kinds of characters in the ordinary model, and times that it is fitted again at most.
BACKOFF, REFITS = 5.0, 5
#: Least length of a candidate, as of a base value.
MIN_CANDIDATE = 6

# The base patterns. A class of both cases stands for letters in either case.
ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % MIN_CANDIDATE)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base matches, leftmost and non-overlapping within each kind, in order."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def value(text: str, span: tuple[int, int, int]) -> str:
    """What a base span holds: of an assignment, the right-hand side."""
    found = text[span[0] : span[2]]
    return ASSIGN.match(found)[1] if span[1] == 0 else found


def _apart(base: list[tuple[int, int, int]]) -> Callable[[int, int], bool]:
    """Tells, of ranges asked for in order, whether they touch no base span."""
    i = reach = 0

    def free(start: int, end: int) -> bool:
        nonlocal i, reach
        while i < len(base) and base[i][0] < end:
            reach = max(reach, base[i][2])
            i += 1
        return reach <= start

    return free


def beyond(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the candidates that hold an access or hex base span and letters or digits beside it, of the first one's
    kind: the run is one token, a part of which is sure, and what is ordinary beside that doesn't count against it. What
    an assignment holds is whole already, as its value ends with the run; a candidate ends where one begins."""
    sure, assigns, reach = [], [], 0
    for x in base:
        if x[1] == 0:
            assigns.append(x[0])
            reach = max(reach, x[2])
        elif x[0] >= reach:
            sure.append(x)
    if not sure:
        return []
    out, i = [], 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        j = i
        while j < len(sure) and sure[j][0] < end:
            j += 1
        if j == i:
            continue
        p = bisect_left(assigns, sure[i][0])
        if p < len(assigns) and assigns[p] < end:
            end = max(assigns[p], *(x[2] for x in sure[i:j]))
        at, other = start, False
        for s, _, e in [*sure[i:j], (end, 0, end)]:
            other = other or any(c.isalnum() for c in text[at:s])
            at = max(at, e)
        if other:
            out.append((start, sure[i][1], end))
        i = j
    return out


def symbols(s: str) -> list[int]:
    """Kinds of characters: the automata's alphabet."""
    return [_SYMBOL[c] for c in s]


# Digits, a-f, other small letters, A-F, other capitals, and each sign by itself.
_GROUPS = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-")
_SYMBOL = {c: i for i, g in enumerate(_GROUPS) for c in g}
_SIZES = np.array([len(g) for g in _GROUPS], float)
ALPHABET = len(_GROUPS)
#: Lengths up to this one are told apart; beyond it, their powers of two.
LENGTHS = 64


def opening(v: list[int]) -> list[int]:
    """The two symbols that a string begins with: one of the set of its kinds of characters, and one of its length. In
    automata they follow the alphabet's own: what comes first decides which states the characters go through."""
    n = len(v)
    length = n if n <= LENGTHS else LENGTHS + (n - 1).bit_length() - 6
    return [ALPHABET + sum(1 << c for c in set(v)), -1 - length]


class Automaton:
    """A probabilistic deterministic automaton, inferred by merging compatible states of a prefix tree.

    A string goes from the start by the set of its kinds of characters to one state, by its length to the next, and on by
    its characters. Two states of the same of these three levels are compatible if no frequency of a symbol, or of what
    follows it, differs by more than Hoeffding's bound allows. Blue states (children of red ones) are merged into the first
    compatible red state, in the order of their first visits, or become red."""

    def __init__(self, values: list[list[int]], alpha: float = 0.05):
        self.next: list[dict[int, int]] = [{}]
        self.counts: list[dict[int, int]] = [{}]
        self.level = [0]
        for v in values:
            at = 0
            for c in [*opening(v), *v]:
                self.counts[at][c] = self.counts[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.level.append(min(self.level[at] + 1, 2))
                    self.next.append({})
                    self.counts.append({})
                at = self.next[at][c]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        # at the start and after it, unseen symbols have the weight of one of a tenth; characters are of their kinds' sizes
        self.opening = [{c: math.log(n / (sum(k.values()) + 0.1)) for c, n in k.items()} | {None: math.log(0.1 / (sum(k.values()) + 0.1))} for k in self.counts]
        p = np.array([[k.get(c, 0) + 0.05 for c in range(ALPHABET)] for k in self.counts])
        self.logs = np.log(p / p.sum(1, keepdims=True)) - np.log(_SIZES)  # of one character, not of its kind

    def _differ(self, a: dict[int, int], b: dict[int, int]) -> bool:
        n, m = sum(a.values()), sum(b.values())
        if not n or not m:
            return False
        limit = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return any(abs(a.get(c, 0) / n - b.get(c, 0) / m) > limit for c in a.keys() | b.keys())

    def _compatible(self, red: int, blue: int) -> bool:
        if self.level[red] != self.level[blue]:
            return False
        todo = [(red, blue)]
        while todo:
            r, b = todo.pop()
            if self._differ(self.counts[r], self.counts[b]):
                return False
            todo += [(self.next[r][c], y) for c, y in self.next[b].items() if c in self.next[r]]
        return True

    def _fold(self, red: int, blue: int) -> None:
        """Adds a blue subtree to a red state and what follows it."""
        todo = [(red, blue)]
        while todo:
            r, b = todo.pop()
            for c, n in self.counts[b].items():
                self.counts[r][c] = self.counts[r].get(c, 0) + n
            for c, y in self.next[b].items():
                if c in self.next[r]:
                    todo.append((self.next[r][c], y))
                else:
                    self.next[r][c] = y

    def _merge(self) -> None:
        red, seen = [0], {0}
        while True:
            blue = next(((r, c) for r in red for c, y in self.next[r].items() if y not in seen), None)
            if blue is None:
                break
            r, c = blue
            b = self.next[r][c]
            into = next((x for x in red if self._compatible(x, b)), None)
            if into is None:
                red.append(b)
                seen.add(b)
            else:
                self.next[r][c] = into
                self._fold(into, b)
        number = {x: i for i, x in enumerate(red)}
        self.level = [self.level[x] for x in red]
        self.next = [{c: number[y] for c, y in self.next[x].items()} for x in red]
        self.counts = [self.counts[x] for x in red]

    def knows(self, v: list[int]) -> bool:
        """Whether a value with the same kinds of characters and the same length is among those it is inferred from."""
        first, length = opening(v)
        return first in self.next[0] and length in self.counts[self.next[0][first]]

    def score(self, v: list[int]) -> float:
        """Log probability of a value. A symbol that no value has at a state has a small one; at the start the most visited
        state of the next level follows, later the state stays."""
        at, total = 0, 0.0
        for c in opening(v):
            total += self.opening[at].get(c, self.opening[at][None])
            at = self.next[at][c] if c in self.next[at] else max(self.next[at].items(), key=lambda x: (self.counts[at][x[0]], -x[0]), default=(0, at))[1]
        for c in v:
            total += self.logs[at, c]
            at = self.next[at].get(c, at)
        return total


class Ordinary:
    """An even mixture of two models of ordinary candidates: bigrams of characters, and bigrams of kinds of characters, in
    which a run of one kind is likely even where the sample has few of them (numbers). The first backs off to the second."""

    def __init__(self, values: list[str]):
        chars = "".join(_GROUPS) + "\n"
        self.at = {c: i for i, c in enumerate(chars)}
        kinds = np.array([_SYMBOL.get(c, ALPHABET) for c in chars])
        n = np.zeros((len(chars), len(chars)))
        for v in values:
            x = [self.at[c] for c in f"\n{v}\n"]
            np.add.at(n, (x[:-1], x[1:]), 1)
        pairs = np.full((ALPHABET + 1, ALPHABET + 1), 0.5 / (ALPHABET + 1)) + 0.5 * np.eye(ALPHABET + 1)
        np.add.at(pairs, (kinds[:, None], kinds[None, :]), n)
        back = (pairs / pairs.sum(1, keepdims=True))[kinds][:, kinds] / np.append(_SIZES, 1)[kinds]
        self.kinds = np.log(back)
        self.logs = np.log((n + BACKOFF * back) / (n.sum(1, keepdims=True) + BACKOFF))

    def score(self, v: str) -> float:
        x = [self.at[c] for c in f"\n{v}\n"]
        return float(np.logaddexp(self.logs[x[:-1], x[1:]].sum(), self.kinds[x[:-1], x[1:]].sum())) - math.log(2)


class Grammar:
    """Automata by kind and the ordinary model. A candidate is a credential if an automaton makes it LEVEL likelier than
    the ordinary model does, as a whole, so that a short one needs more evidence for each character.

    The sample of candidates isn't labelled, so those that are credentials by this rule don't count as ordinary; what is
    left gives the ordinary model anew. It begins with those whose set of kinds of characters and length no labelled value has,
    or, if that leaves out most of them, with all."""

    def __init__(self, values: dict[int, list[str]], ordinary: list[str]):
        self.automata = {k: Automaton([symbols(v) for v in vs]) for k, vs in sorted(values.items()) if len(vs) >= MIN_VALUES}
        rest = [v for v in ordinary if not any(a.knows(symbols(v)) for a in self.automata.values())]
        if len(rest) < len(ordinary) / 2:
            rest = ordinary
        for _ in range(REFITS):
            self._set(rest)
            kept = self._plain(ordinary)
            if kept == rest:
                break
            rest = kept

    def _set(self, ordinary: list[str]) -> None:
        self.ordinary = Ordinary(ordinary)
        self.cache: dict[str, int] = {}
        # over all kinds, the most that a character can add to the odds by bigrams of characters, after another one
        chars, logs = list(self.ordinary.at), self.ordinary.logs
        most = [np.append(a.logs.max(0), 0.0) for a in self.automata.values()]
        best = np.max(most, axis=0)[[_SYMBOL.get(c, ALPHABET) for c in chars]] if most else np.full(len(chars), -np.inf)
        self.gain = {c: dict(zip(chars, (best - logs[i]).tolist())) for i, c in enumerate(chars)}

    def _plain(self, ordinary: list[str]) -> list[str]:
        """Those that count as ordinary. With the characters and length of labelled values, a candidate that an automaton
        makes likelier at all doesn't, else the few below the level would draw all others of their format after them."""
        like = lambda v: any(a.knows(symbols(v)) and self.odds(k, v) > 0 for k, a in self.automata.items())
        return [v for v in ordinary if self.kind(v) < 0 and not like(v)]

    def odds(self, kind: int, v: str) -> float:
        return self.automata[kind].score(symbols(v)) - self.ordinary.score(v)

    def kind(self, v: str) -> int:
        """The kind of a candidate, or -1."""
        got = self.cache.get(v)
        if got is None:
            at, bound = self.gain["\n"], math.log(2)
            for c in v:
                bound += at[c]
                at = self.gain[c]
            got = -1
            if bound + at["\n"] > LEVEL:  # else no automaton can reach it
                best = max((self.odds(k, v), -k) for k in self.automata)
                got = -best[1] if best[0] > LEVEL else -1
            if len(self.cache) > 200_000:
                self.cache.clear()
            if len(v) <= 64:
                self.cache[v] = got
        return got

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans of candidates that don't touch a base span and whose format is a credential's."""
        if all(self.kind(v) < 0 for v in set(CANDIDATE.findall(text))):
            return []
        out, free = [], _apart(base)
        for m in CANDIDATE.finditer(text):
            if free(m.start(), m.end()):
                k = self.kind(m[0])
                if k >= 0:
                    out.append((m.start(), k, m.end()))
        return out


def learn(docs: DataFrame, *, text: str = "text") -> Grammar:
    """Automata from bounded samples of what the base patterns match and of other candidates, taken from all texts: those
    with the smallest hashes of distinct values, so that the order of rows and repeated rows don't matter."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, set[str]] = {k: set() for k in range(-1, len(KINDS))}
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    base = base_spans(t)
                    for x in base:
                        seen[x[1]].add(value(t, x))
                    free = _apart(base)
                    seen[-1].update((m[0] for m in CANDIDATE.finditer(t) if free(*m.span())) if base else CANDIDATE.findall(t))
            for k, s in seen.items():
                if len(s) > 20_000 or k >= 0:  # keep what can still be among the smallest
                    seen[k] = set(_smallest(s, SAMPLE_VALUES if k >= 0 else SAMPLE_ORDINARY))
        rows = [(k, v) for k, s in seen.items() for v in _smallest(s, SAMPLE_VALUES if k >= 0 else SAMPLE_ORDINARY)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.string())], ["kind", "value"])

    found = saved(pick(docs, text=text).mapInArrow(values, "kind int, value string").distinct())
    got: dict[int, list[str]] = {}
    keyed = found.withColumn("h", F.crc32(F.col("value").cast("binary")))
    for k in range(-1, len(KINDS)):
        n = SAMPLE_VALUES if k >= 0 else SAMPLE_ORDINARY
        got[k] = [r.value for r in keyed.filter(F.col("kind") == k).orderBy("h", "value").limit(n).collect()]
    return Grammar({k: got[k] for k in range(len(KINDS))}, got[-1])


def _smallest(values: set[str], n: int) -> list[str]:
    return sorted((v for v in values if len(v) <= SAMPLE_CHARS), key=lambda v: (zlib.crc32(v.encode()), v))[:n]


SPANS_SQL = "base array<struct<kind: string, start: long, end: long>>, spans array<struct<kind: string, start: long, end: long>>"


def scan(docs: DataFrame, grammar: Grammar, *, text: str = "text") -> DataFrame:
    """Each row of docs, with its columns called _0, _1 and so on, and base and spans: arrays of (kind, start, end) in
    code points, end exclusive, by start and then by kind; spans holds the base spans, those that the automata add, and
    those of `beyond`.

    A null or empty text has none. Texts are read whole, at any length. Equal rows have equal spans; no rows give no
    rows. Where the sample holds fewer than
    10 values of a kind, no automaton of it adds spans."""
    out = held(docs)
    at = docs.columns.index(text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]
        for b in batches:
            schema = pa.schema([*b.schema, pa.field("base", span), pa.field("spans", span)])
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                base, spans = [], []
                for t in part.column(at).to_pylist():
                    own = base_spans(t) if t else []
                    more = grammar.added(t, own) + beyond(t, own) if t else []
                    base.append(named(own))
                    spans.append(named(sorted(own + more)) if more else base[-1])
                yield rows_to([*part.columns, base, spans], schema)

    return out.mapInArrow(run, f"{fields}, {SPANS_SQL}")


def without_secrets(docs: DataFrame, *, text: str = "text", n_chars: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by the mark (spans that overlap by one mark); all documents stay, and the columns
    too. n_chars, if docs has it, is the new number of code points where a text has changed."""
    names = docs.columns
    found = scan(docs, learn(docs, text=text), text=text)
    c = f"_{names.index(text)}"
    # spans joined where they overlap: the pieces of text between them
    step = lambda acc, x: F.when(x["start"] < acc["at"], F.struct(acc["out"].alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))).otherwise(
        F.struct(F.concat(acc["out"], F.substring(F.col(c), (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit(mark)).alias("out"), x["end"].alias("at"))
    )
    init = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    last = lambda acc: F.concat(acc["out"], F.substring(F.col(c), (acc["at"] + 1).cast("int"), F.char_length(c)))
    hit = F.size("spans") > 0
    found = found.withColumn(c, F.when(hit, F.aggregate("spans", init, step, last)).otherwise(F.col(c)))
    if n_chars in names:
        k = f"_{names.index(n_chars)}"
        found = found.withColumn(k, F.when(hit, F.char_length(c).cast(found.schema[k].dataType)).otherwise(F.col(k)))
    return found.select(*[f"_{i}" for i in range(len(names))]).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    found = scan(docs, learn(docs))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(F.col("_0").alias("doc_id"), *[n(k) for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
