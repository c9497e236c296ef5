"""Operator 3, exact byte-level BPE by dynamic programming over prefixes.

The BPE encoding of a prefix has one last token, and it decides the rest: if the encoding of a text ends at position e with
token t, then what comes before is the encoding of the text up to e - |t|. So one number per prefix is enough. An automaton
of all tokens (the suffix matches of each prefix) gives the candidates; a candidate t is the last token if the last token p
of the prefix before it is compatible with it, that is, if BPE of p's bytes followed by t's bytes is [p, t]. The ids are
then read off the back-pointers. Time is linear in the text for any text, one of a million letters without a space included.

Short pre-tokens that a slice of rows has and the table of known ones lacks are merged all at once instead, as rows of a matrix: in each
round every row makes its merge of the least rank, the leftmost of these.

The pair test walks down the two tokens' merges along their common edge, and its results are kept in a bounded table, like the
encodings of pre-tokens that recur. Encoding is a map over rows: nothing is shuffled, texts are read once.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterable
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh, need, slices, worker_state

#: How a text is cut before BPE: contractions, letters, digits and signs with a space before them, white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of a pre-token that is merged in a matrix with others.
_SHORT = 32
#: Pre-tokens whose ids a worker keeps (about 250 bytes each), and pairs.
_KEPT = 300_000


def read_vocabulary(path: str) -> list[bytes]:
    """The tokens' bytes by id, from lines of base64 and rank."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f if line.strip()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must count from 0")
    return [t for _, t in pairs]


def splits(tokens: list[bytes]) -> np.ndarray:
    """(n, 2): the two tokens that each token is merged from; itself twice if it is merged from none."""
    rank = {t: i for i, t in enumerate(tokens)}
    out = np.empty((len(tokens), 2), dtype=np.int32)
    for i, t in enumerate(tokens):
        parts = [t[k : k + 1] for k in range(len(t))]
        while len(parts) > 2:
            best, at = i, -1
            for k in range(len(parts) - 1):
                r = rank.get(parts[k] + parts[k + 1], i)
                if r < best:
                    best, at = r, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        out[i] = (rank[parts[0]], rank[parts[1]]) if len(parts) == 2 and parts[0] in rank and parts[1] in rank else (i, i)
    return out


class Encoder:
    """Encodes and decodes with one vocabulary; ``table`` is what splits() returns for it."""

    def __init__(self, tokens: list[bytes], table: np.ndarray, pattern: str | None = PATTERN):
        self.tokens, self.lengths = tokens, [len(t) for t in tokens]
        self.left, self.right = table[:, 0].tolist(), table[:, 1].tolist()
        self.merged = {(a, b): i for i, (a, b) in enumerate(zip(self.left, self.right, strict=True)) if a != i}
        self.cut = regex.compile(pattern).findall if pattern else lambda text: [text] if text else []
        self.words: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.numbers = list(range(len(tokens)))  # one object for each id, however often it is kept
        trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, t in enumerate(tokens):
            if len(t) == 1 or self.left[i] != i:  # a longer token without a merge is never made
                trie.add_word(t.decode("latin-1"), i)
        trie.make_automaton()
        self.suffixes = trie.iter
        self.single = np.full(256, -1, dtype=np.int64)
        for i, t in enumerate(tokens):
            if len(t) == 1:
                self.single[t[0]] = i
        made = np.array([(a * len(tokens) + b, i) for (a, b), i in self.merged.items()], dtype=np.int64).reshape(-1, 2)
        self.keys, self.made = made[made[:, 0].argsort()].T.copy()
        self.whole = {t.decode("utf-8"): [self.numbers[i]] for i, t in enumerate(tokens) if (len(t) == 1 or self.left[i] != i) and _is_text(t)}

    def compatible(self, p: int, t: int) -> bool:
        """Whether BPE leaves p and t as they are when they stand side by side."""
        if len(self.pairs) > _KEPT:
            self.pairs.clear()
        known = self.pairs[p, t] = self._compatible(p, t)
        return known

    def _compatible(self, p: int, t: int) -> bool:
        # The pair of tokens that stood at the edge is undone, the younger one first; if any two that met there would have
        # merged before the younger one was made, BPE would not have come to (p, t).
        left, right, merged, before = self.left, self.right, self.merged, len(self.tokens)
        while True:
            if merged.get((p, t), before) < before:
                return False
            if p > t and right[p] != p or left[t] == t:
                if right[p] == p:
                    return True
                before, p = p, right[p]
            else:
                before, t = t + 1, left[t]

    def piece(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        last = [-1] * (len(data) + 1)
        lengths, pairs, compatible = self.lengths, self.pairs, self.compatible
        for end, t in self.suffixes(data.decode("latin-1")):
            end += 1
            if last[end] >= 0:  # there is only one, and it has been found
                continue
            start = end - lengths[t]
            if start:
                p = last[start]
                if p < 0:
                    continue
                fine = pairs.get((p, t))
                if not (compatible(p, t) if fine is None else fine):
                    continue
            last[end] = t
        out, at, numbers = [], len(data), self.numbers
        while at:
            t = last[at]
            if t < 0:
                raise ValueError("the vocabulary lacks bytes of this text")
            out.append(numbers[t])
            at -= lengths[t]
        out.reverse()
        return out

    def _merges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that two are merged to; the number of tokens if there is none."""
        none = len(self.tokens)
        if len(self.keys) == 0:
            return np.full(a.shape, none, dtype=np.int64)
        key = np.where((a >= 0) & (b >= 0), a * none + b, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], none)

    def short_pieces(self, data: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of pre-tokens of up to _SHORT bytes each, by merging in rank order."""
        if not data:
            return []
        sizes, none, numbers = np.array([len(d) for d in data]), len(self.tokens), self.numbers
        out: list[tuple[int, ...]] = [()] * len(data)
        for low, wide in ((0, 8), (8, 16), (16, _SHORT)):
            rows = np.flatnonzero((sizes > low) & (sizes <= wide))
            if not len(rows):
                continue
            raw = np.frombuffer(b"".join([data[r].ljust(wide, b"\0") for r in rows.tolist()]), dtype=np.uint8).reshape(-1, wide)
            inside = np.arange(wide) < sizes[rows, None]
            ids = np.where(inside, self.single[raw], -1)
            if (inside & (ids < 0)).any():
                raise ValueError("the vocabulary lacks bytes of this text")
            # A last column without a token or a merge moves in from the right.
            ids = np.concatenate([ids, np.full((len(rows), 1), -1)], axis=1)
            ranks = np.full(ids.shape, none, dtype=np.int64)
            ranks[:, :-1] = self._merges(ids[:, :-1], ids[:, 1:])
            columns = np.arange(wide + 1)
            while True:
                at = ranks.argmin(axis=1)
                best = np.take_along_axis(ranks, at[:, None], axis=1)[:, 0]
                done = best == none
                if done.any():
                    for r, row in zip(rows[done].tolist(), ids[done].tolist(), strict=True):
                        out[r] = tuple([numbers[t] for t in row[: row.index(-1)]])
                    go = ~done
                    rows, ids, ranks, at, best = rows[go], ids[go], ranks[go], at[go], best[go]
                if not len(rows):
                    break
                every = np.arange(len(rows))
                ids[every, at] = best
                right = np.minimum(columns + (columns > at[:, None]), wide)
                ids = np.take_along_axis(ids, right, axis=1)
                ranks = np.take_along_axis(ranks, right, axis=1)
                ranks[every, at] = self._merges(best, ids[every, at + 1])
                some = at > 0
                ranks[every[some], at[some] - 1] = self._merges(ids[every[some], at[some] - 1], best[some])
        return out

    def encode_all(self, texts: list[str | None]) -> list[list[int] | None]:
        """The ids of each text, None for None. Pre-tokens that aren't known are found out together."""
        words, cuts = self.words, [None if t is None else self.cut(t) for t in texts]
        distinct = set(chain.from_iterable([c for c in cuts if c]))
        new = [w for w in distinct if w not in words]
        if len(words) + len(new) > _KEPT:
            words.clear()
            new = list(distinct)
        short, long = [], []
        for w in new:
            ids = self.whole.get(w)
            if ids is not None:
                words[w] = ids
                continue
            data = w.encode("utf-8", "surrogatepass")
            if len(data) <= _SHORT:
                short.append((w, data))
            else:
                words[w] = self.piece(data)
                if len(w) > 64:
                    long.append(w)
        words.update(zip([w for w, _ in short], self.short_pieces([d for _, d in short]), strict=True))
        out = [None if c is None else list(chain.from_iterable(map(words.__getitem__, c))) for c in cuts]
        for w in long:
            del words[w]
        if len(words) > _KEPT:
            words.clear()
        return out

    def encode(self, text: str) -> list[int]:
        words, out = self.words, []
        for w in self.cut(text):
            ids = words.get(w)
            if ids is None:
                ids = self.whole.get(w) or self.piece(w.encode("utf-8", "surrogatepass"))
                if len(w) <= 64:
                    if len(words) >= _KEPT:
                        words.clear()
                    words[w] = ids
            out += ids
        return out

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _is_text(t: bytes) -> bool:
    try:
        t.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _encoder(spark: SparkSession, path: str, pattern: str | None):
    """A function that gives the worker's encoder. Vocabulary and merges (about 1 MB) are read once, by the driver, and broadcast."""
    tokens = read_vocabulary(path)
    shared, key = spark.sparkContext.broadcast((tokens, splits(tokens))), uuid.uuid4().hex

    def get() -> Encoder:
        state = worker_state("bpe")
        if key not in state:
            state.clear()
            state[key] = Encoder(*shared.value, pattern)
        return state[key]

    return get


def bpe_encode(
    spark: SparkSession, docs: DataFrame, *, text: str = "text", ids: str = "ids", keep: list[str] | None = None,
    vocabulary: str = VOCABULARY, pattern: str | None = PATTERN, check: str | None = None,
) -> DataFrame:
    """All columns (or those of ``keep``) and an array column ``ids`` with the text's exact BPE ids.

    With ``check``, a boolean column of that name says whether decoding the ids gives the text back. Null text: null ids
    (and null check). Empty text: no ids. Very long texts are encoded whole, in linear time. Repeated rows are each encoded;
    there are no ties, as every prefix has one last token. Empty table: empty result. Extra columns pass through; if one has the
    name ``ids`` or ``check`` (in any case), the new column's name gets underscores at its end.
    """
    need(docs, text)
    names = docs.columns if keep is None else list(keep)
    kept = docs.select(*map(col, names))
    added = [fresh(kept, a) for a in [ids] + ([check] if check else [])]
    get = _encoder(spark, vocabulary, pattern)
    schema = T.StructType([*(docs.schema[n] for n in names), T.StructField(added[0], T.ArrayType(T.IntegerType()))] + ([T.StructField(added[1], T.BooleanType())] if check else []))
    source = fresh(docs, "_bpe_text")

    def run(batches):
        e = get()
        for b in slices(batches, source, 4_000_000):
            texts = b.column(len(names)).to_pylist()
            rows = e.encode_all(texts)
            columns = [*(b.column(k) for k in range(len(names))), pa.array(rows, type=pa.list_(pa.int32()))]
            if check:
                columns.append(pa.array([None if t is None else e.decode_bytes(r) == t.encode("utf-8", "surrogatepass") for t, r in zip(texts, rows, strict=True)], type=pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    return docs.select(*map(col, names), col(text).cast("string").alias(source)).mapInArrow(run, schema)


def bpe_decode(spark: SparkSession, encoded: DataFrame, *, ids: str = "ids", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """All other columns and the decoded text in a column ``text``, which replaces one of that name.

    Null ids: null text; no ids: empty text. Bytes that are no UTF-8 become replacement characters. An id beyond the vocabulary
    is an error. Long lists are decoded whole, repeated rows each; there are no ties. Empty table: empty result. Extra columns pass through.
    """
    need(encoded, ids)
    names = [n for n in encoded.columns if n not in (ids, text)]
    get = _encoder(spark, vocabulary, None)
    schema = T.StructType([*(encoded.schema[n] for n in names), T.StructField(text, T.StringType())])

    def run(batches):
        e = get()
        for b in batches:
            texts = [None if r is None else e.decode(r) for r in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(names))), pa.array(texts, type=pa.string())], names=[*names, text])

    return encoded.select(*map(col, names), col(ids).cast("array<int>").alias(fresh(encoded, "_bpe_ids"))).mapInArrow(run, schema)
