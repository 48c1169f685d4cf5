"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

The items' words go into one automaton (in blocks of bounded size, if there are many), and each document's words stream
through it. At each word the automaton knows the longest stretch that ends there and occurs in an item. Stretches of
`window` words or more, and whole items that are shorter, are hit. Documents are neither shuffled nor collected."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _arrow as A
from ._spark import held, pick, rows_to, saved, table

#: Words of items that one automaton holds (about 0.5 KB each in a worker); the items beyond go into further passes.
BLOCK_WORDS = 200_000
#: An item beyond so many words is cut into pieces that overlap by window-1 words, so that no window is lost.
PIECE_WORDS = 20_000


class SuffixAutomaton:
    """All stretches of all items. Items are lists of word numbers; each may be a whole item or a piece of one."""

    def __init__(self, items: list[tuple[str | None, list[int]]], window: int):
        self.window, self.next, self.link, self.len = window, [{}], [-1], [0]
        ends = []
        for _, item in items:
            last = 0
            for w in item:
                last = self._extend(last, w)
            ends.append(last)
        #: items by the state of each of their windows, and of each whole item under a window's length
        self.items: dict[int, set[str | None]] = {}
        short: set[int] = set()
        for (name, item), end in zip(items, ends):
            if 0 < len(item) < window:
                self.items.setdefault(end, set()).add(name)
                short.add(end)
            elif item:
                v = 0
                for i, w in enumerate(item):
                    v = self.next[v][w]
                    while self.len[self.link[v]] >= window:
                        v = self.link[v]
                    if i >= window - 1:
                        self.items.setdefault(v, set()).add(name)
        #: the nearest state, this one or up its suffix links, at which a short item ends; 0: none
        self.short = [0] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.len.__getitem__):
            self.short[v] = v if v in short else self.short[self.link[v]]
        self.least = min((min(len(x), window) for _, x in items if x), default=0)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        q = nxt[last].get(w)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        cur = self._state({}, -1, length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return cur

    def _split(self, p: int, w: int, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.link[q], self.len[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _state(self, nxt: dict, link: int, length: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.len.append(length)
        return len(self.next) - 1

    def stream(self, words: list[int]) -> tuple[list[int], list[int], set[int]]:
        """For each word the length of the longest match that ends there, and of the longest window; the states met."""
        nxt, link, length, window, short = self.next, self.link, self.len, self.window, self.short
        v = n = 0
        longest, hits, met = [], [], set()
        for w in words:
            while v and w not in nxt[v]:
                v = link[v]
                n = length[v]
            if w in nxt[v]:
                v, n = nxt[v][w], n + 1
            hit, u = 0, v
            if n >= window:
                hit = window
                while length[link[u]] >= window:
                    u = link[u]
                met.add(u)
            u = short[v]
            if u == v and length[u] > n:
                u = short[link[v]]
            if u:
                hit = max(hit, length[u])
                while u:
                    met.add(u)
                    u = short[link[u]]
            longest.append(n)
            hits.append(hit)
        return longest, hits, met


class Matcher:
    """An automaton behind a vectorised sieve. Only runs of words in which each next pair of words occurs in an item,
    and which are as long as the shortest window, can hold a window; the automaton streams over those alone."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], window: int):
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *[x for _, x in items]]))
        numbered = [(name, np.searchsorted(self.vocabulary, x)) for name, x in items]
        n = np.int64(len(self.vocabulary))
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *[x[:-1] * n + x[1:] for _, x in numbered]]))
        self.automaton = SuffixAutomaton([(name, x.tolist()) for name, x in numbered], window)

    def find(self, h: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, list[int], list[int], set[int]]]:
        """For each run: the first and the end word's place, and what stream() says."""
        least = self.automaton.least
        if not least or not len(h):
            return
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[at] == h)
        if not len(known):
            return
        k = at[known].astype(np.int64)
        pair = k[:-1] * np.int64(len(self.vocabulary)) + k[1:]
        together = (np.diff(known) == 1) & (doc[known[1:]] == doc[known[:-1]])
        together[together] = _among(pair[together], self.pairs)
        starts = np.flatnonzero(np.concatenate([[True], ~together]))
        lengths = np.diff(np.concatenate([starts, [len(known)]]))
        for s, n in zip(starts[lengths >= least].tolist(), lengths[lengths >= least].tolist()):
            yield int(known[s]), int(known[s]) + n, *self.automaton.stream(k[s : s + n].tolist())


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


_MATCHERS: dict[str, Matcher] = {}


def _matcher(key: str, items: list[tuple[str | None, bytes]], window: int) -> Matcher:
    if key not in _MATCHERS:
        _MATCHERS.clear()  # a worker keeps one at a time
        _MATCHERS[key] = Matcher([(name, np.frombuffer(x, np.uint64)) for name, x in items], window)
    return _MATCHERS[key]


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64()), ("first", pa.int64())])
FOUND = {"n_words": pa.int64(), "longest": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "spans": pa.list_(SPAN)}
FOUND_SQL = "n_words long, longest long, n_hit long, items array<string>, spans array<struct<start: long, end: long, words: long, first: long>>"


def item_blocks(items: DataFrame, item_id: str, text: str, window: int, block_words: int = BLOCK_WORDS) -> list[list[tuple[str | None, bytes]]]:
    """The items' words as hashes, in blocks of about block_words words. One block is on the driver at a time only if
    the caller handles them one by one: this yields lists lazily."""

    def pieces(batches):
        for b in batches:
            data, off, _ = A.buffers(b.column(1))
            for i, j, doc, _, _, h in A.words(data, off):
                cuts = np.searchsorted(doc, np.arange(i, j + 1))
                for t in range(i, j):
                    own = h[cuts[t - i] : cuts[t - i + 1]]
                    if len(own):
                        step = PIECE_WORDS - window + 1
                        parts = [own[a : a + PIECE_WORDS].tobytes() for a in range(0, max(1, len(own) - window + 1), step)]
                        yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[t].as_py()] * len(parts), pa.string()), pa.array(parts, pa.binary())], ["name", "words"])

    read = pick(items, item_id=item_id, text=text).select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    found = saved(read.mapInArrow(pieces, "name string, words binary"))
    total = found.select(F.coalesce(F.sum(F.length("words")), F.lit(0))).first()[0] // 8
    blocks = max(1, -(-total // block_words))
    dealt = found.withColumn("block", F.pmod(F.xxhash64("name", "words"), F.lit(blocks)))
    for b in range(blocks):
        yield [(r.name, bytes(r.words)) for r in dealt.filter(F.col("block") == b).select("name", "words").collect()]


def contamination(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Each row of docs, with its columns called _0, _1 and so on, and what of it the test items hold.

    n_words; longest: words of the longest match, 0 if it is shorter than the shortest window; n_hit: words within windows; items: ids of
    the items with occurring windows, sorted as strings, each once; spans: the runs of hit words, as code points
    [start, end), the number of words and the number of the first.

    Words are [0-9a-z] and characters beyond ASCII after A-Z are lower-cased; they are compared by 64-bit hashes. A
    null or empty text has no words. An item without words has no window; one with a null id hits, but is not listed.
    Repeated rows each get their own result, equal items count once for each id. An empty table of items hits nothing."""
    names, n = docs.columns, len(docs.columns)
    at = names.index(text)
    out = held(docs)
    for number, block in enumerate(item_blocks(items, item_id, item_text, window, block_words)):
        if number:
            out = saved(out)  # so that only one automaton is in a worker at a time
        key = hashlib.sha256(repr((window, sorted(block, key=repr))).encode()).hexdigest()

        def scan(batches, block=block, key=key, number=number):
            matcher = _matcher(key, block, window)
            for b in batches:
                yield from _scan(b, matcher, n, at, number)

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[:n])
        out = out.mapInArrow(scan, f"{fields}, {FOUND_SQL}")
    return out


def _scan(b: pa.RecordBatch, matcher: Matcher, n: int, at: int, number: int) -> Iterator[pa.RecordBatch]:
    data, off, _ = A.buffers(b.column(at))
    schema = pa.schema([*[b.schema.field(i) for i in range(n)], *[pa.field(k, v) for k, v in FOUND.items()]])
    for i, j, doc, s, e, h in A.words(data, off):
        cuts = np.searchsorted(doc, np.arange(i, j + 1))
        longest, met, back = np.zeros(j - i, np.int64), {}, {}
        for first, _, lengths, hits, states in matcher.find(h, doc):
            d = int(doc[first]) - i
            longest[d] = max(longest[d], max(lengths))
            if states:
                met.setdefault(d, set()).update(states)
                back.setdefault(d, []).extend((first + k - x + 1, first + k + 1) for k, x in enumerate(hits) if x)
        before = b.slice(i, j - i)
        items, spans, n_hit = [[]] * (j - i), [[]] * (j - i), np.zeros(j - i, np.int64)
        for d in set(back) | ({k for k in range(j - i) if before.column(n + 4)[k].as_py()} if number else set()):
            ranges = [(a - int(cuts[d]), z - int(cuts[d])) for a, z in back.get(d, ())]
            names = {x for v in met.get(d, ()) for x in matcher.automaton.items[v] if x is not None}
            if number:
                ranges += [(x["first"], x["first"] + x["words"]) for x in before.column(n + 4)[d].as_py()]
                names |= set(before.column(n + 3)[d].as_py())
            joined: list[list[int]] = []
            for a, z in sorted(ranges):
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], z)
                else:
                    joined.append([a, z])
            items[d], spans[d] = sorted(names), _spans(data, int(off[i + d]), s[cuts[d] :], e[cuts[d] :], joined)
            n_hit[d] = sum(z - a for a, z in joined)
        if number:
            longest = np.maximum(longest, before.column(n + 1).to_numpy())
        yield rows_to([*[before.column(c) for c in range(n)], np.diff(cuts), longest, n_hit, items, spans], schema)


def _spans(data: np.ndarray, base: int, s: np.ndarray, e: np.ndarray, joined: list[list[int]]) -> list[dict]:
    out, at, chars = [], base, 0
    count = lambda a, z: int(((data[a:z] & 0xC0) != 0x80).sum())
    for a, z in joined:
        start, end = int(s[a]), int(e[z - 1])
        chars += count(at, start)
        out.append({"start": chars, "end": (stop := chars + count(start, end)), "words": z - a, "first": a})
        at, chars = end, stop
    return out


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", n_chars: str | None = "n_chars", max_coverage: float = 0.5, **options) -> DataFrame:
    """docs without what they share with the test items; the columns stay as they are.

    Spans of hit words (see contamination()) are cut out, each replaced by one space; a document of which the spans
    cover more than max_coverage of the words goes altogether. A document without a hit stays as it is, also with a
    null text. The column n_chars, if docs has it, is the new number of code points where the text has changed."""
    names = docs.columns
    at = f"_{names.index(text)}"
    found = contamination(docs, items, text=text, **options).filter(F.col("n_hit") <= F.col("n_words") * F.lit(max_coverage))
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda x: x["end"]))
    starts = F.concat(F.transform("spans", lambda x: x["start"]), F.array(F.char_length(at).cast("long")))
    kept = F.array_join(F.zip_with(ends, starts, lambda a, z: F.substring(F.col(at), (a + 1).cast("int"), (z - a).cast("int"))), " ")
    found = found.withColumn(at, F.when(F.size("spans") > 0, kept).otherwise(F.col(at)))
    if n_chars in names:
        c = f"_{names.index(n_chars)}"
        found = found.withColumn(c, F.when(F.size("spans") > 0, F.char_length(at).cast(found.schema[c].dataType)).otherwise(F.col(c)))
    return found.select(*[f"_{i}" for i in range(len(names))]).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        F.col("_0").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT cast(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i + 1:i + k], ' ') AS s
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT k FROM windows),
places AS (
  SELECT r, k, i, array_to_string(w[i + 1:i + k], ' ') AS s
  FROM (SELECT r, k, w, unnest(range(len(w) - k + 1)) AS i FROM d, sizes WHERE len(w) >= k)
), hits AS (SELECT a.r, a.k, a.i, x.item_id FROM places a JOIN windows x ON a.k = x.k AND a.s = x.s),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT r, i, k FROM hits)) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit, cast(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN ids USING (r)
"""
