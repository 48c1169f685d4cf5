"""Phrase collocations: n-grams as rows, counted by language, scored by their weakest cut, with parts of longer phrases left out.

Texts are cut into pieces at punctuation and line ends, and pieces into words. The 1..max_words-grams of pieces become rows of
a DataFrame, already summed within a slice of texts, and are hash-aggregated, those of one word first. A phrase can't be
frequent if a part of it isn't, so that longer ones become rows only if their parts pass a sieve of the frequent ones; the
sieve has a fixed size and lets some others pass, whose counts then tell. A phrase is joined to the counts of both sides of
each of its cuts; a phrase that mostly occurs within another one is found by the one-word extensions: if a longer phrase
holds it often enough, so does the one with a single word more, since each holds all occurrences of the longer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._arrow import BASE, _tables, buffers, mix
from ._spark import pick, saved, table

#: Bytes of text that are counted at once; a longer text is cut at the end of a piece. Four times as many take 90 MB more of a
#: worker's memory and spare one bigram in 14.
SLICE_BYTES = 1 << 19
#: The sieve of frequent phrases has 2^SIEVE_BITS bits: 4 MB.
SIEVE_BITS = 25
#: Parts of a language's phrases that are ranked apart, before the best of all parts are.
PARTS = 64


def _classes() -> np.ndarray:
    """0 for bytes of words, 1 for what parts words, 2 for what parts pieces."""
    t = np.zeros(256, np.uint8)
    t[[32, 9]] = 1
    t[[*b".,;:!?", 10, 11, 12, 13]] = 2
    return t


CLASSES = _classes()
LOWER = np.arange(256).astype(np.uint8)
LOWER[65:91] += 32


def slices(data: np.ndarray, off: np.ndarray, size: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes with a line end behind each text, each text's place among them, and its number; a text longer than size comes
    in parts that end with pieces."""
    n, i, size = len(off) - 1, 0, size or SLICE_BYTES
    while i < n:
        j = min(max(int(np.searchsorted(off, off[i] + size, "right")) - 1, i + 1), n)
        at, end = int(off[i]), int(off[j])
        while end - at > size:  # one long text
            cut = np.flatnonzero(CLASSES[data[at : at + size]] == 2)
            look = at + size
            while not len(cut) and look < end:  # no piece ends here: the next end counts
                cut = np.flatnonzero(CLASSES[data[look : min(look + size, end)]] == 2) + look - at
                look += size
            if not len(cut):
                break
            stop = at + int(cut[-1] if look == at + size else cut[0]) + 1
            yield data[at:stop], np.zeros(1, np.int64), np.array([i])
            at = stop
        if j == i + 1:
            yield data[at:end], np.zeros(1, np.int64), np.array([i])
        else:
            texts = np.arange(j - i)
            out = np.full(end - at + j - i, 10, np.uint8)
            out[np.arange(end - at) + np.repeat(texts, np.diff(off[i : j + 1]))] = data[at:end]
            yield out, off[i:j] - at + texts, texts + i
        i = j


def hashes(texts: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, the same on all machines."""
    data, off, _ = buffers(texts)
    data, off = data[off[0] : off[-1]], off - off[0]
    up, down = _tables(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * up[: len(data)], out=run[1:])
    return mix(((run[off[1:]] - run[off[:-1]]) * down[off[:-1]]) ^ (np.diff(off).astype(np.uint64) << np.uint64(56)))


def longer(first: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one word more."""
    return mix(first * BASE + word)


def passes(sieve: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the sieve has the bits of hashes: it has all that were put in, and some others."""
    at = h >> np.uint64(64 - SIEVE_BITS)
    return (sieve[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def ngrams(raw: np.ndarray, places: np.ndarray, lang: np.ndarray, names: pa.Array, sieves: list[np.ndarray]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(languages, phrases, counts) of a slice's phrases of one word more than there are sieves, of which all shorter parts
    pass theirs; without sieves, also the empty phrase, which counts all words. lang: the number of each text's language among
    names. Phrases are told apart by numbers of their words, not by hashes."""
    if not len(raw):
        return
    kind = CLASSES[raw]
    inside = np.concatenate([[False], kind == 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return
    off = np.concatenate([[0], np.cumsum(ends - starts)])
    letters = LOWER[raw[kind == 0]]
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
    vocabulary, word = words.dictionary, words.indices.to_numpy().astype(np.int64)
    spoken = lang[np.searchsorted(places, starts, "right") - 1]
    key, word, count = np.unique(spoken * len(vocabulary) + word, return_inverse=True, return_counts=True)
    of, singles = key // len(vocabulary), vocabulary.take(pa.array(key % len(vocabulary)))
    if not sieves:
        yield names, pa.array([""] * len(names), pa.large_string()), np.bincount(spoken, minlength=len(names))
        yield names.take(pa.array(of)), singles, count
        return
    piece = np.cumsum(kind == 2, dtype=np.int64)[starts]
    single = hashes(vocabulary)[key % len(vocabulary)]
    h = longer(hashes(names)[of], single)
    parts, gram = [np.arange(len(singles))], word
    for n, sieve in enumerate(sieves, 2):
        good = passes(sieve, h)[gram] & (gram >= 0)
        at = np.flatnonzero(good[:-1] & good[1:] & (piece[1:] == piece[:-1]))  # both its parts of n - 1 words pass
        if not len(at):
            return
        key, inverse, count = np.unique(gram[at] * len(singles) + word[at + n - 1], return_inverse=True, return_counts=True)
        first, last = key // len(singles), key % len(singles)
        h, parts, of = longer(h[first], single[last]), [*[x[first] for x in parts], last], of[first]
        gram = np.full(len(word), -1, np.int64)
        gram[at] = inverse
    yield names.take(pa.array(of)), pc.binary_join_element_wise(*[singles.take(pa.array(x)) for x in parts], pa.scalar(" ", pa.large_string())), count


def counted(docs: DataFrame, sieves: list[np.ndarray]) -> DataFrame:
    """lang, phrase and a, how often it occurs, for phrases of one word more than there are sieves; docs: text and lang."""

    def count(batches):
        for b in batches:
            names = b.column(1).fill_null("und").dictionary_encode()
            code = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            data, off, _ = buffers(b.column(0))
            for raw, places, texts in slices(data, off):
                for of, phrases, n in ngrams(raw, places, code[texts], names.dictionary, sieves):
                    for at in range(0, len(n), 1 << 17):
                        part = slice(at, at + (1 << 17))
                        yield pa.RecordBatch.from_arrays([of[part].cast(pa.string()), phrases[part].cast(pa.string()), pa.array(n[part].astype(np.int64))], ["lang", "phrase", "c"])

    return docs.mapInArrow(count, "lang string, phrase string, c long").groupBy("lang", "phrase").agg(F.sum("c").alias("a"))


def sieve_of(frequent: DataFrame) -> np.ndarray:
    """A sieve of 2^SIEVE_BITS bits that all phrases of a table (lang, phrase) pass: of that size at any number of them."""

    def bits(batches):
        for b in batches:
            lang, words = b.column(0), pc.split_pattern(b.column(1), " ")
            h, n = hashes(lang), pc.list_value_length(words).to_numpy(zero_copy_only=False)
            of, first = hashes(words.flatten()), np.concatenate([[0], np.cumsum(n)])[:-1]
            for k in range(int(n.max(initial=0))):
                more = n > k
                h[more] = longer(h[more], of[first[more] + k])
            at = h >> np.uint64(64 - SIEVE_BITS)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["at", "bits"])

    rows = frequent.select("lang", "phrase").mapInArrow(bits, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(1 << (SIEVE_BITS - 6), np.uint64)
    for b in rows.toArrow().to_batches():
        out[b.column(0).to_numpy()] = b.column(1).to_numpy().view(np.uint64)
    return out


def words_of(phrase: str = "phrase"):
    return F.length(phrase) - F.length(F.replace(F.col(phrase), F.lit(" "))) + 1


def collocations(docs: DataFrame, *, max_words: int = 3, least: int = 10, within: int = 50, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to max_words words.

    a is the number of the phrase's occurrences, least at the least; l and r those of the two sides of its weakest cut,
    score the floor of 1,000,000 a a / (l r) there, the first such cut counting; n is the number of the language's words.
    Phrases of which `within` percent or more lie in one longer phrase are left out, whether that one is kept or not. The
    order is by score and a, both falling, and then by the phrase's bytes. Products are decimals: exact for counts to 1e15.

    A null language is `und`, together with the language of that name. Null and empty texts, empty tables and texts
    without words give no rows; repeated rows count each; ties can't remain, as phrases differ. Other columns, of no matter
    what name, don't matter."""
    rows, sieves = pick(docs, text=text, lang=lang), []
    frequent = saved(counted(rows, sieves).filter((F.col("a") >= least) | (F.col("phrase") == "")))
    totals = frequent.filter("phrase = ''").select("lang", F.col("a").alias("n"))
    counts = last = frequent.filter(f"phrase <> '' AND a >= {int(least)}")
    for _ in range(1, max_words):
        sieves = [*sieves, sieve_of(last)]
        last = saved(counted(rows, sieves).filter(F.col("a") >= least))
        counts = counts.unionByName(last)
    candidates = counts.withColumn("w", words_of()).filter("w > 1")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("w") - 1))).withColumn("left", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("right", F.expr("substr(phrase, length(left) + 2)"))
    side = lambda name, as_: counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(as_))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    score = F.expr("(cast(1000000 AS decimal(7,0)) * (cast(a AS decimal(15,0)) * cast(a AS decimal(15,0)))) div (cast(l AS decimal(18,0)) * cast(r AS decimal(18,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    parts = candidates.filter("w > 2").withColumn("part", F.explode(F.array(F.expr("substring_index(phrase, ' ', w - 1)"), F.expr("substring_index(phrase, ' ', 1 - w)"))))
    longer = parts.groupBy("lang", F.col("part").alias("phrase")).agg(F.max("a").alias("longer"))
    drop = candidates.join(longer, ["lang", "phrase"]).filter(F.col("longer") * 100 >= F.col("a") * within).select("lang", "phrase")
    kept = scored.join(drop, ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    by_part = Window.partitionBy("lang", "part").orderBy(*order)
    best = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", F.row_number().over(by_part)).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), max_words=3, least=10, within=50, top=2000)


ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces
), places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 0
), grams AS (
  SELECT lang, 1 AS w, ws[i] AS phrase FROM places
  UNION ALL SELECT lang, 2, ws[i] || ' ' || ws[i + 1] FROM places WHERE i + 1 <= len(ws)
  UNION ALL SELECT lang, 3, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FROM places WHERE i + 2 <= len(ws)
), f AS (SELECT lang, w, phrase, count(*) AS a FROM grams GROUP BY ALL
), n AS (SELECT lang, cast(sum(a) AS BIGINT) AS n FROM f WHERE w = 1 GROUP BY lang
), c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE w > 1 AND a >= 10
), cut AS (
  SELECT lang, phrase, a, 1 AS k, ws[1] AS left_, array_to_string(ws[2:], ' ') AS right_ FROM c
  UNION ALL SELECT lang, phrase, a, 2, ws[1] || ' ' || ws[2], ws[3] FROM c WHERE w = 3
), s AS (
  SELECT cut.*, x.a AS l, y.a AS r, cast(cast(1000000 AS HUGEINT) * cut.a * cut.a // (cast(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = left_ JOIN f y ON y.lang = cut.lang AND y.phrase = right_
), weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM s
), longer AS (
  SELECT lang, ws[1] || ' ' || ws[2] AS phrase, a FROM c WHERE w = 3 UNION ALL SELECT lang, ws[2] || ' ' || ws[3], a FROM c WHERE w = 3
), kept AS (
  SELECT * FROM weakest x WHERE o = 1 AND NOT EXISTS (SELECT 1 FROM longer y WHERE y.lang = x.lang AND y.phrase = x.phrase AND 100 * y.a >= 50 * x.a)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
