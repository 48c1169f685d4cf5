"""Token counts by offset-mapped attribution.

A whole document is encoded once. Tokens' byte offsets come from the tokens' lengths, and a sorted merge gives each
token to the sections (lines, fields) that its characters lie in. A token over a border goes by an explicit rule."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import held, pick, rows_to, table

#: What a token over a border between sections counts for: the section of its first character, the one with most of its
#: bytes (the first of equals), or each by its share of the bytes.
RULES = ("first", "most", "share")
#: Encoded chunks that a worker remembers at most, and the bytes of the longest.
CACHED, CACHED_BYTES = 400_000, 64
#: White space other than single spaces between words.
IRREGULAR = re.compile(r"\s\s|^\s|\s$|\s \s")
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed public vocabularies have a file; workers find it in the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """A byte-level BPE encoder that gives the byte lengths of a text's tokens.

    A single space between two words always begins a token, so the chunks between such places are encoded for
    themselves, and frequent chunks once for a worker."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)
        self.cache: dict[str, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return self.size[self.bpe.encode_to_numpy(text, allowed_special=set(), disallowed_special=())]

    def _chunk(self, chunk: str) -> bytes:
        sizes = self._encode(chunk)
        got = sizes.astype(np.uint16).tobytes()
        if len(chunk) <= CACHED_BYTES:
            if len(self.cache) >= CACHED:
                self.cache.clear()
            self.cache[chunk] = got
        return got

    def sizes(self, text: str) -> np.ndarray:
        """Bytes of each token of a text, in order."""
        if IRREGULAR.search(text):
            chunks, at = [], 0
            for m in SINGLE_SPACE.finditer(text):
                chunks.append(text[at : m.start()])
                at = m.start()
            chunks.append(text[at:])
        else:
            first, *rest = text.split(" ")
            chunks = [first, *[" " + x for x in rest]]
        cache, own = self.cache, self._chunk
        return np.frombuffer(b"".join([cache.get(c) or own(c) for c in chunks if c]), np.uint16).astype(np.int64)


def encoder(path: str, pattern: str) -> Encoder:
    key = hashlib.sha256(f"{path}\0{pattern}".encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, pattern)
    return _ENCODERS[key]


def attribute(sizes: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section and the number of tokens over a border. sizes: bytes of the tokens in order; borders: the
    bytes at which sections begin, from 0, with the end at last. Sections may be empty."""
    n = len(borders) - 1
    end = np.cumsum(sizes)
    start = end - sizes
    last = np.maximum(end - 1, 0)
    # the last of the sections that begin at a byte is the one that isn't empty
    first_in = np.searchsorted(borders[1:], start, "right")
    last_in = np.searchsorted(borders[1:], last, "right")
    over = np.flatnonzero(first_in != last_in)
    counts = np.bincount(first_in, minlength=n).astype(np.float64 if rule == "share" else np.int64)
    if rule != "first":
        for t in over.tolist():
            sections = np.arange(first_in[t], last_in[t] + 1)
            own = np.minimum(end[t], borders[sections + 1]) - np.maximum(start[t], borders[sections])
            counts[first_in[t]] -= 1
            if rule == "most":
                counts[sections[int(own.argmax())]] += 1
            else:
                counts[sections] += own / own.sum()
    return counts, len(over)


def line_borders(raw: bytes) -> np.ndarray:
    """Lines as sections: each with the \\n that ends it; a text that ends with \\n has no empty line after it."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return np.concatenate([[0], ends, [len(raw)] if not len(ends) or ends[-1] < len(raw) else []]).astype(np.int64)


def by_line(docs: DataFrame, *, text: str = "text", rule: str = "first", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Each row of docs, with its columns called _0, _1 and so on, and n_tokens, n_sections, n_crossing, tokens.

    tokens: the number of tokens of each line (long, or double for the rule "share"); they add up to n_tokens.
    n_crossing: tokens that hold bytes of more than one line. A null or empty text has no line and no token. Strings that
    look like special tokens are ordinary text. Repeated rows are counted each; no rows give no rows."""
    return by_fields(docs, [text], rule=rule, path=path, pattern=pattern, lines=True)


def by_fields(docs: DataFrame, fields: list[str], *, rule: str = "first", path: str | None = None, pattern: str | None = None, lines: bool = False) -> DataFrame:
    """As by_line(), for text columns that are encoded together, as one text with nothing between them: the sections are
    the fields in order (or with lines=True the lines of the whole); a null field is empty and has a section."""
    import public_tokenizers

    if rule not in RULES:
        raise ValueError(f"rule {rule!r}: one of {RULES}")
    path, pattern = path or vocabulary_path(), pattern or public_tokenizers.PATTERN
    at = [docs.columns.index(f) for f in fields]
    out = held(docs)
    kind = "double" if rule == "share" else "long"
    listed = pa.list_(pa.float64() if rule == "share" else pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            schema = pa.schema([*b.schema, *[pa.field(n, pa.int64()) for n in ("n_tokens", "n_sections", "n_crossing")], pa.field("tokens", listed)])
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                rows: list[tuple] = []
                for texts in zip(*[part.column(i).to_pylist() for i in at]):
                    whole = "".join(t or "" for t in texts)
                    if lines:
                        borders = line_borders(whole.encode()) if whole else np.zeros(1, np.int64)
                    else:
                        borders = np.concatenate([[0], np.cumsum([len((t or "").encode()) for t in texts])])
                    sizes = enc.sizes(whole) if whole else np.zeros(0, np.int64)
                    counts, over = attribute(sizes, borders, rule)
                    rows.append((len(sizes), len(borders) - 1, over, counts.tolist()))
                yield rows_to([*part.columns, *map(list, zip(*rows))] if rows else [*part.columns, [], [], [], []], schema)

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    return out.mapInArrow(run, f"{names}, n_tokens long, n_sections long, n_crossing long, tokens array<{kind}>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return by_line(docs).select(F.col("_0").alias("doc_id"), "n_tokens", "n_sections", "n_crossing", "tokens")
