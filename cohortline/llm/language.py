"""Language identification by a linear-chain conditional random field over words.

A word's features are the n-grams of its bytes between a start and an end mark (those that hold a mark are its affixes)
and its place in a lexicon learned from the sample. Weights and transitions are learned by gradient on exact
forward-backward marginals of sequences that are stitched together from documents of different languages, so that the
transitions are those of code-switched text. A document's language has the highest mean marginal over its words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _arrow as A
from ._spark import held, pick, table

#: Documents of each language that the model is fitted on at most: those whose texts have the smallest hashes.
SAMPLE_DOCS = 200
#: Only documents up to this many characters are fitted on, so that the driver's memory is bounded.
SAMPLE_CHARS = 6_000
BUCKETS = 1 << 16
GRAMS = (2, 3, 4, 5)
SEGMENT = 64
START, END = 2, 3  # marks: bytes that are in no word


def word_features(data: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of all words, and where each word's begin. The last is the word itself."""
    size = (e - s) + 2
    begin = np.concatenate([[0], np.cumsum(size)])
    flat = np.zeros(begin[-1] + max(GRAMS), np.uint64)
    word = np.repeat(np.arange(len(s)), size)
    place = np.arange(begin[-1]) - begin[:-1][word]
    inner = (place > 0) & (place < size[word] - 1)
    flat[:-max(GRAMS)][inner] = A.ALNUM[data[(s[word] + place - 1)[inner]]]
    flat[begin[:-1]], flat[begin[1:] - 1] = START, END
    found, of = [], []
    for n in GRAMS:
        code = np.zeros(begin[-1], np.uint64)
        for k in range(n):
            code |= flat[k : begin[-1] + k] << np.uint64(8 * k)
        ok = place + n <= size[word]
        found.append(((code[ok] * A.BASE) >> np.uint64(48)).astype(np.int32))
        of.append(word[ok])
    found.append((A.mix(h) >> np.uint64(48)).astype(np.int32))
    of.append(np.arange(len(s)))
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return np.concatenate(found)[order], np.searchsorted(of[order], np.arange(len(s)))


def has_letter(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Whether each word has a letter: quickly for ASCII, by the character's kind else."""
    first = data[s]
    out = ((first | 32) >= 97) & ((first | 32) <= 122)
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in bytes(data[s[i] : e[i]]).decode("utf-8", "replace"))
    return out


class Chain:
    """A fitted model: weights of buckets, lexicon weights, transitions and starts, all by language."""

    def __init__(self, languages: list[str]):
        n = len(languages)
        self.languages = languages
        self.w = np.zeros((BUCKETS, n), np.float32)
        self.trans = np.zeros((n, n))
        self.start = np.zeros(n)
        self.lexicon = np.zeros(0, np.uint64)
        self.lex_of = np.zeros(0, np.int64)
        self.lex_w = np.zeros(n)

    def learn_lexicon(self, h: np.ndarray, y: np.ndarray, least: int = 2) -> None:
        """Words that occur at least so often in one language, and thrice as often as in all others."""
        words, at = np.unique(h, return_inverse=True)
        counts = np.zeros((len(words), len(self.languages)))
        np.add.at(counts, (at, y), 1)
        top, best = counts.max(1), counts.argmax(1)
        ok = (top >= least) & (top >= 3 * (counts.sum(1) - top))
        self.lexicon, self.lex_of = words[ok], best[ok]

    def lexical(self, h: np.ndarray) -> np.ndarray:
        """The lexicon's language of each word, or -1."""
        if not len(self.lexicon):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == h, self.lex_of[at], -1)

    def emissions(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each word by language, 0 for words without a letter; and whether it has one."""
        uniq, first, back = np.unique(h, return_index=True, return_inverse=True)
        letters = has_letter(data, s[first], e[first])
        buckets, begin = word_features(data, s[first], e[first], uniq)
        out = np.add.reduceat(self.w[buckets], begin, axis=0).astype(np.float64)
        lex = self.lexical(uniq)
        known = np.flatnonzero(lex >= 0)
        out[known, lex[known]] += self.lex_w[lex[known]]
        out[~letters] = 0
        return out[back], letters[back]

    def marginals(self, emit: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Exact posteriors of each word's language, of sequences that begin where `first` is true.

        Forward and backward messages run over segments of 64 words at once: each segment's messages as a matrix
        first, then from segment to segment, then inside all segments again."""
        n, k = emit.shape
        if not n:
            return emit
        c = -(-n // SEGMENT)
        psi = np.ones((c * SEGMENT, k))
        psi[:n] = np.exp(emit - emit.max(1, keepdims=True))
        reset = np.ones(c * SEGMENT, bool)
        reset[:n] = first
        psi, reset = psi.reshape(c, SEGMENT, k), reset.reshape(c, SEGMENT)
        t, pi = np.exp(self.trans - self.trans.max()), np.exp(self.start - self.start.max())
        m = np.broadcast_to(np.eye(k), (c, k, k)).copy()
        for i in range(SEGMENT):
            r = reset[:, i]
            step = m @ t
            if r.any():
                step[r] = m[r].sum(2, keepdims=True) * pi
            m = step * psi[:, i, None, :]
            m /= m.sum((1, 2), keepdims=True)
        into, out_of = np.ones((c, k)), np.ones((c, k))
        for i in range(1, c):
            v = into[i - 1] @ m[i - 1]
            into[i] = v / v.sum()
        for i in range(c - 2, -1, -1):
            v = m[i + 1] @ out_of[i + 1]
            out_of[i] = v / v.sum()
        fwd = np.empty_like(psi)
        a = into
        for i in range(SEGMENT):
            a = np.where(reset[:, i, None], pi, a @ t) * psi[:, i]
            a = a / a.sum(1, keepdims=True)
            fwd[:, i] = a
        b = out_of
        for i in range(SEGMENT - 1, -1, -1):
            fwd[:, i] *= b
            v = psi[:, i] * b
            b = np.where(reset[:, i, None], 1.0, v @ t.T)
            b = b / b.sum(1, keepdims=True)
        out = fwd.reshape(c * SEGMENT, k)[:n]
        return out / out.sum(1, keepdims=True)


def fit(texts: list[str], labels: list[str], epochs: int = 4, rate: float = 0.25, ridge: float = 1e-5, seed: int = 7) -> Chain:
    """A model of whole labelled texts. Sequences are 32 words: half of one document alone, half of pieces of several."""
    languages = sorted(set(labels))
    model = Chain(languages)
    data, off, _ = A.buffers(pa.array(texts, pa.string()))
    parts = list(A.words(data, off))
    if not parts or not sum(len(p[3]) for p in parts):
        return model
    doc, s, e, h = (np.concatenate([p[i] for p in parts]) for i in (2, 3, 4, 5))
    number = {x: i for i, x in enumerate(languages)}
    y = np.array([number[x] for x in labels])[doc]
    model.learn_lexicon(h, y)
    uniq, first, back = np.unique(h, return_index=True, return_inverse=True)
    letters = has_letter(data, s[first], e[first])
    buckets, begin = word_features(data, s[first], e[first], uniq)
    ends = np.append(begin[1:], len(buckets))
    lex = model.lexical(uniq)
    rng = np.random.default_rng(seed)
    k, length, batch = len(languages), 32, 128
    gw, gt, gs, gl = np.full((BUCKETS, k), 1e-3, np.float32), np.full((k, k), 1e-3), np.full(k, 1e-3), np.full(k, 1e-3)
    pieces = [np.arange(a, min(a + length, z)) for d0, d1 in zip(np.flatnonzero(np.diff(doc, prepend=-1)), np.append(np.flatnonzero(np.diff(doc)) + 1, len(doc))) for z in [d1] for a in range(d0, d1, length)]
    for _ in range(epochs):
        order = rng.permutation(len(pieces))
        for b in range(0, len(order), batch):
            chosen = [pieces[i] for i in order[b : b + batch]]
            sequences = chosen[: len(chosen) // 2]
            rest = chosen[len(chosen) // 2 :]
            for i in range(0, len(rest) - 2, 3):  # code-switched: short pieces of three documents
                sequences.append(np.concatenate([r[: rng.integers(4, 13)] for r in rest[i : i + 3]]))
            at = np.concatenate(sequences)
            start = np.zeros(len(at), bool)
            start[np.concatenate([[0], np.cumsum([len(x) for x in sequences])[:-1]])] = True
            ids, where = np.unique(back[at], return_inverse=True)
            own = np.concatenate([np.arange(begin[i], ends[i]) for i in ids])
            cut = np.concatenate([[0], np.cumsum(ends[ids] - begin[ids])[:-1]])
            emit = np.add.reduceat(model.w[buckets[own]], cut, axis=0).astype(np.float64)
            in_lex = np.flatnonzero(lex[ids] >= 0)
            emit[in_lex, lex[ids][in_lex]] += model.lex_w[lex[ids][in_lex]]
            emit[~letters[ids]] = 0
            post = model.marginals(emit[where], start)
            gold = np.zeros_like(post)
            gold[np.arange(len(at)), y[at]] = 1
            d = np.zeros_like(emit)
            np.add.at(d, where, gold - post)
            d[~letters[ids]] = 0
            pair, seen = _pairs(model, emit[where], start, post, y[at])
            scale = 1.0 / len(sequences)
            grad = np.repeat(d, np.diff(np.append(cut, len(own))), axis=0).astype(np.float32) * scale
            g = np.zeros_like(model.w)
            np.add.at(g, buckets[own], grad)
            touched = np.unique(buckets[own])
            gw[touched] += g[touched] ** 2
            model.w[touched] += rate * (g[touched] / np.sqrt(gw[touched]) - ridge * model.w[touched])
            for x, acc, gr in ((model.trans, gt, (seen - pair) * scale), (model.start, gs, (gold[start] - post[start]).sum(0) * scale)):
                acc += gr**2
                x += 0.1 * rate * gr / np.sqrt(acc)
            gr = np.zeros(k)
            np.add.at(gr, lex[ids][in_lex], d[in_lex, lex[ids][in_lex]])
            gl += (gr * scale) ** 2
            model.lex_w += 0.1 * rate * gr * scale / np.sqrt(gl)
    return model


def _pairs(model: Chain, emit: np.ndarray, start: np.ndarray, post: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected and seen counts of transitions. The pair's joint is exact up to scaling: forward message times transition
    times backward message, recovered from the posteriors and one more forward pass."""
    n, k = emit.shape
    psi = np.exp(emit - emit.max(1, keepdims=True))
    t, pi = np.exp(model.trans - model.trans.max()), np.exp(model.start - model.start.max())
    begins = np.flatnonzero(start)
    lengths = np.diff(np.append(begins, n))
    fwd = np.empty_like(psi)
    joint, seen = np.zeros((k, k)), np.zeros((k, k))
    for i in range(int(lengths.max(initial=0))):
        at = begins[lengths > i] + i
        if i == 0:
            a = pi * psi[at]
        else:
            a = (fwd[at - 1] @ t) * psi[at]
            back = post[at] / np.maximum(a, 1e-300)  # psi times backward, up to a scale for each word
            x = fwd[at - 1][:, :, None] * t[None] * (psi[at] * back)[:, None, :]
            joint += (x / x.sum((1, 2), keepdims=True)).sum(0)
            np.add.at(seen, (y[at - 1], y[at]), 1)
        fwd[at] = a / a.sum(1, keepdims=True)
    return joint, seen


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Chain:
    """A model of at most sample_docs texts of each language of docs; null texts and languages don't count."""
    read = pick(docs, text=text, lang=lang).filter("text IS NOT NULL AND lang IS NOT NULL").filter(F.char_length("text") <= sample_chars)
    read = read.withColumn("h", F.xxhash64("text"))
    # the smallest hashes of each of 64 parts of a language, then of the language: no task ranks all of its rows
    least = read.select("lang", "h").distinct().withColumn("part", F.pmod("h", F.lit(64)))
    for by in (["lang", "part"], ["lang"]):
        least = least.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).filter(F.col("n") <= sample_docs)
    last = least.groupBy("lang").agg(F.max("h").alias("last")).collect()
    if not last:
        return Chain([])
    chosen = read.filter(F.coalesce(*[F.when(F.col("lang") == r.lang, F.col("h") <= r.last) for r in last])) if len(last) <= 64 else read.join(docs.sparkSession.createDataFrame(last), "lang").filter("h <= last")
    rows = sorted((r.lang, r.text) for r in chosen.dropDuplicates(["lang", "h"]).select("lang", "text").collect())
    return fit([r[1] for r in rows], [r[0] for r in rows])


def identify(docs: DataFrame, model: Chain, *, text: str = "text") -> DataFrame:
    """Each row of docs, with its columns called _0, _1 and so on, and lang_pred, score and certainty.

    lang_pred is `und` and score 0 where the text is null or has no letter, and everywhere if nothing was learned; else
    score is the mean posterior of the language over the words with letters, and certainty the mean of each word's highest
    posterior, of whatever language, which is high in mixed texts too. Texts are read whole, at any length. Of
    languages with the same mean the first in order counts. Repeated rows are labelled each; no rows give no rows."""
    n, at = len(docs.columns), docs.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off, _ = A.buffers(b.column(at))
            for i, j, doc, s, e, h in A.words(data, off):
                langs, scores, sure = ["und"] * (j - i), [0.0] * (j - i), [0.0] * (j - i)
                if len(s) and model.languages:
                    emit, letters = model.emissions(data, s, e, h)
                    post = model.marginals(emit, np.diff(doc, prepend=-1) != 0)
                    begin = np.flatnonzero(np.diff(doc, prepend=-1))
                    total = np.add.reduceat(post * letters[:, None], begin, axis=0)
                    highest = np.add.reduceat(post.max(1) * letters, begin)
                    count = np.add.reduceat(letters.astype(np.int64), begin)
                    for d, row, top, c in zip(doc[begin] - i, total, highest, count):
                        if c:
                            best = int(row.argmax())
                            langs[d], scores[d], sure[d] = model.languages[best], min(1.0, float(row[best] / c)), min(1.0, float(top / c))
                columns = [x.slice(i, j - i) for x in b.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.float64())], [*b.schema.names, "lang_pred", "score", "certainty"])

    out = held(docs)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    return out.mapInArrow(scan, f"{fields}, lang_pred string, score double, certainty double")


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves no remainder by 5; a null id is an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def keep_identified(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", min_score: float = 0.4) -> DataFrame:
    """docs without those whose language can't be told: no letter, or words whose highest posteriors have a mean under
    min_score. Texts in several languages stay if their words are certain.
    The model learns from the rows that aren't held out; if there is no language to learn from, all documents stay. The
    columns stay as they are."""
    names = docs.columns
    model = train(pick(docs, doc_id=doc_id, text=text, lang=lang).filter(~held_out()))
    if not model.languages:
        return docs
    found = identify(docs, model, text=text).filter((F.col("lang_pred") != "und") & (F.col("certainty") >= min_score))
    return found.select(*[f"_{i}" for i in range(len(names))]).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text", lang="lang")
    model = train(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select(F.col("_0").alias("doc_id"), held_out("_0").alias("held_out"), "lang_pred", "score")
