"""Operator 6, SimHash near-dedup by segment-popcount embedding.

A document's fingerprint is a 256-bit SimHash of its distinct words. Copies with equal words share a fingerprint and are folded before
the join, so a group of thousands of exact copies costs one row. The join finds every pair of fingerprints within ``k`` bits.

* The k + 1 bits that a pair would need to be too far are dealt out over the fingerprint: 11 to each word of 64 bits at k = 43, of these 5 and 6
  to its halves, of these 2 or 3 to their halves. A pair within k is below its share in some word, there in some half, and there in some
  quarter. So a quarter of 16 bits names the rows to compare (its own bucket and those at most 1 or 2 bits away, 2.6 % of the pairs of evenly
  spread fingerprints), half and word drop nearly all of those, and what is left is verified by the Hamming distance. No pair is lost.
* Fingerprints are cut into blocks by a hash of their id; each pair of blocks is a task, and a few blocks are cut by quarters besides. Below
  some 10,000 million pairs a task compares them all, as that is cheaper than its million buckets. Blocks and tasks change no result.
* Of a task's links only a spanning forest leaves, not all pairs; and the components of those edges are found by rounds of star
  contraction, each written to the shared folder.

``exact=False`` joins by a grid of given size instead, which may lose pairs. The fingerprint is cut into 128 segments of two bits, and the
vector of their bit counts is its embedding: the Manhattan distance of two embeddings, over any of the segments, is at most the Hamming distance.

* The grid has cell width 1 over ``tables`` projections of the embedding, of ``segments`` segments each. A fingerprint goes to its
  home cell and to ``probes`` of the neighbour cells at Manhattan distance 1: those on the side of the bits that were decided
  with the least majority, as these are the first to differ in a near copy. Two fingerprints that share a cell of either kind
  are a candidate pair; so a table joins the range of Manhattan radius 2 as far as it is likely, and radius 0 always.
* Over all 128 segments the Manhattan distance, a lower bound, drops the candidates beyond ``k``. Embeddings are kept in unary
  code for it, two bits a segment, so the distance is one exclusive or and a population count. What is left is verified.

A cell that holds more than ``hot`` fingerprints is split into blocks, and each pair of blocks is solved in a task of its own.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, drop_path, fresh, need, save, slices, whole_id, worker_state

BITS = 256
WORDS = BITS // 64
SEGMENTS = BITS // 2
_word = re.compile(r"\w+")


class _Hashes(dict):
    """Word to the 32 bytes of its hash, bounded."""

    def __missing__(self, word: str) -> bytes:
        if len(self) > 200_000:
            self.clear()
        w = word.encode("utf-8", "surrogatepass")
        self[word] = h = xxhash.xxh3_128_digest(w) + xxhash.xxh3_128_digest(w, seed=1)
        return h


def signed(text: str | None, least: int = 8) -> tuple[bytes | None, np.ndarray | None]:
    """(fingerprint, majority of each bit, negative for zeros). See ``fingerprint``; where that isn't of words there is no majority."""
    if text is None:
        return None, None
    words = _word.findall(text.lower())
    distinct = set(words)
    if len(distinct) < least:
        whole = "\u0000".join(words) if words else "\u0001" + text
        w = whole.encode("utf-8", "surrogatepass")
        return xxhash.xxh3_128_digest(w, seed=2) + xxhash.xxh3_128_digest(w, seed=3), None
    state = worker_state("simhash")
    hashes = state.get("simhash") or state.setdefault("simhash", _Hashes())
    packed = np.frombuffer(b"".join(map(hashes.__getitem__, distinct)), dtype=np.uint8).reshape(-1, BITS // 8)
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(packed), 255):  # sums of up to 255 bits fit a byte
        ones += np.unpackbits(packed[k : k + 255], axis=1).sum(axis=0, dtype=np.uint8)
    majority = 2 * ones - len(packed)
    return np.packbits(majority > 0).tobytes(), majority


def fingerprint(text: str | None, least: int = 8) -> bytes | None:
    """256 bits. None for null. Texts of fewer than ``least`` distinct words get a hash of their word sequence instead (of the
    text as it is, if it has no word), so that they only match copies of equal words."""
    return signed(text, least)[0]


def weak_sides(majorities: np.ndarray) -> np.ndarray:
    """(n, 64) bytes from (n, 256) majorities: for each segment, which of its two bits is the less certain one, and how early (0 to 7) it comes
    in the order of certainty among the segments."""
    sure = np.abs(majorities).reshape(len(majorities), SEGMENTS, 2)
    which = sure.argmin(axis=2)
    rank = sure.min(axis=2).argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
    code = (which * 8 + np.minimum(rank // 10, 7)).astype(np.uint8)
    return code[:, 0::2] << 4 | code[:, 1::2]


def embed(prints: np.ndarray) -> np.ndarray:
    """(n, 32) bytes to the (n, 128) bit counts of their segments."""
    b = np.unpackbits(prints, axis=1)
    return b[:, 0::2] + b[:, 1::2]


def projections(tables: int, segments: int, seed: int = 7) -> np.ndarray:
    """(tables, segments) segment numbers: as many disjoint sets as fit, then further shuffles."""
    rng, out, left = np.random.default_rng(seed), [], np.array([], dtype=np.int64)
    while len(out) < tables:
        if len(left) < segments:
            left = rng.permutation(SEGMENTS)
        out.append(left[:segments])
        left = left[segments:]
    return np.array(out)


def grid(n: int) -> tuple[int, int, int]:
    """(tables, segments, probes) that suit n distinct fingerprints, for callers to choose by. A cell holds a random fingerprint with probability of about (3/8) ** segments."""
    segments = max(10, int(math.log(max(n, 1) / 30) / math.log(8 / 3)))
    return math.ceil(12 * 1.15 ** (segments - 10)), segments, segments // 2 - 1


def cells_of(prints: np.ndarray, weak: np.ndarray, certain: np.ndarray, chosen: np.ndarray, probes: int):
    """For each table: (cells (n, 1 + probes), of which -1 is none). ``certain``: rows that have no weak sides and no probes."""
    tables, segments = chosen.shape
    weights, span = 3 ** np.arange(segments, dtype=np.int64), 3**segments
    probes = min(probes, segments)
    bits = np.unpackbits(prints, axis=1).reshape(len(prints), SEGMENTS, 2)
    counts = bits.sum(axis=2, dtype=np.int64)
    code = np.empty((len(prints), SEGMENTS), dtype=np.uint8)
    code[:, 0::2], code[:, 1::2] = weak >> 4, weak & 15
    side = 1 - 2 * np.take_along_axis(bits, (code >> 3)[..., None].astype(np.int64), axis=2)[..., 0].astype(np.int64)
    level = code & 7
    for t in range(tables):
        home = counts[:, chosen[t]] @ weights + t * span
        out = np.full((len(prints), 1 + probes), -1, dtype=np.int64)
        out[:, 0] = home
        first = level[:, chosen[t]].argsort(axis=1, kind="stable")[:, :probes]
        out[:, 1:] = home[:, None] + np.take_along_axis(side[:, chosen[t]], first, axis=1) * weights[first]
        out[certain, 1:] = -1
        yield out


def _arrays(b):
    """(ids, prints, weak sides, rows without those) of a batch (id, fp, weak)."""
    certain = b.column(2).is_null().to_numpy(zero_copy_only=False)
    weak = np.frombuffer(b"".join(w or bytes(SEGMENTS // 2) for w in b.column(2).to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1)
    prints = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1)
    return b.column(0).to_numpy(), prints, weak, certain


def block_of(ids: np.ndarray, parts) -> np.ndarray:
    """The block of each id among as many parts, by a hash."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.asarray(parts, dtype=np.uint64)).astype(np.int64)


def _crowded(chosen: np.ndarray, probes: int):
    """Batches of (id, fp, weak) to (cell, n) of the cells that hold a thousandth of 100,000 rows or so. They only guide the split."""

    def counted(held):
        rows = sum(b.num_rows for b in held)
        parts = [_arrays(b)[1:] for b in held]
        for cells in cells_of(*(np.concatenate([p[i] for p in parts]) for i in range(3)), chosen, probes):
            at, n = np.unique(cells[cells >= 0], return_counts=True)
            many = n >= max(16, rows // 1000)
            yield pa.RecordBatch.from_arrays([pa.array(at[many]), pa.array(n[many].astype(np.int64))], names=["cell", "n"])

    def crowded(batches):
        held = []
        for b in batches:
            held += [b] if b.num_rows else []
            if sum(x.num_rows for x in held) >= 100_000:
                yield from counted(held)
                held = []
        if held:
            yield from counted(held)

    return crowded


def _spread(chosen: np.ndarray, probes: int, shared):
    """Batches of (id, fp, weak) to (cell, part, id, fp). ``shared``: crowded cell to the number of its blocks; part is a pair of blocks."""

    def spread(batches):
        hot = shared.value
        crowded = np.array(sorted(hot), dtype=np.int64)
        many = np.array([hot[c] for c in crowded.tolist()], dtype=np.int64)
        for b in batches:
            if b.num_rows == 0:
                continue
            ids, prints, weak, certain = _arrays(b)
            for cells in cells_of(prints, weak, certain, chosen, probes):
                row, k = np.nonzero(cells >= 0)
                cell = cells[row, k]
                part = np.zeros(len(cell), dtype=np.int64)
                if len(crowded):
                    at = np.searchsorted(crowded, cell)
                    parts = np.where(crowded[np.minimum(at, len(crowded) - 1)] == cell, many[np.minimum(at, len(crowded) - 1)], 1)
                    times = np.repeat(np.arange(len(cell)), parts)
                    other = np.arange(len(times)) - np.repeat(np.cumsum(parts) - parts, parts)
                    row, cell, own = row[times], cell[times], block_of(ids[row], parts)[times]
                    part = np.minimum(own, other) * parts[times] + np.maximum(own, other)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(part), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row))], names=["cell", "part", "id", "fp"])

    return spread


def unary(prints: np.ndarray) -> np.ndarray:
    """The embedding in unary code, two bits a segment: the Hamming distance of these is the Manhattan distance of the embeddings."""
    low = np.uint64(0x5555555555555555)
    a, b = prints & low, prints >> np.uint64(1) & low
    return a | b | (a & b) << np.uint64(1)


def _between(x: np.ndarray, a, b) -> np.ndarray:
    d = np.bitwise_count(x[a, 0] ^ x[b, 0]).astype(np.int16)
    for w in range(1, WORDS):
        d += np.bitwise_count(x[a, w] ^ x[b, w])
    return d


class _Forest:
    """Sets of rows; ``add`` unites two and tells whether they were apart."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, a: int) -> int:
        root = self.root
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    def add(self, a: int, b: int) -> bool:
        x, y = self.find(a), self.find(b)
        self.root[max(x, y)] = min(x, y)
        return x != y


def solve_cells(ids: np.ndarray, prints: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int, blocks: np.ndarray | None = None, small: int = 200):
    """Edges (smaller id, larger id, distance) of a spanning forest of the verified pairs of each cell; with ``blocks``, of pairs of two blocks only."""
    codes, forest, out = unary(prints), _Forest(len(ids)), []

    def keep(a, b):
        d = _between(prints, a, b)
        fine = (d <= k) if blocks is None else (d <= k) & (blocks[a] != blocks[b])
        for x, y, n in zip(a[fine].tolist(), b[fine].tolist(), d[fine].tolist(), strict=True):
            if forest.add(x, y):
                p, q = int(ids[x]), int(ids[y])
                out.append((min(p, q), max(p, q), n))

    size = ends - starts
    # Small cells together: each row meets those before it in its cell.
    few = (size > 1) & (size <= small)
    first = np.repeat(starts[few], size[few])
    before = np.arange(len(first)) - np.repeat(np.cumsum(size[few]) - size[few], size[few])
    row = first + before
    upto = np.cumsum(before)
    lo = 0
    while lo < len(row):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + 1_000_000)))
        n = before[lo:hi]
        a = np.repeat(row[lo:hi], n)
        b = np.repeat(first[lo:hi], n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        near = _between(codes, a, b) <= k
        keep(a[near], b[near])
        lo = hi
    for s, e in zip(starts[size > small].tolist(), ends[size > small].tolist(), strict=True):
        step = max(1, 2_000_000 // (e - s))
        for at in range(s, e - 1, step):
            rows = np.arange(at, min(e, at + step))
            near = np.triu(_between(codes, rows[:, None], np.arange(at, e)[None, :]) <= k, 1)
            while near.any():
                # One partner of each row, then those that are apart still: rows of one group don't name all their pairs.
                a = np.nonzero(near.any(axis=1))[0]
                b = near[a].argmax(axis=1)
                keep(rows[a], at + b)
                near[a, b] = False
                label = np.array([forest.find(x) for x in range(at, e)])
                near &= label[: len(rows), None] != label[None, :]
    return out


def _local(k: int, shared):
    """Rows sorted by cell and part, in; edges, out. A cell may run over batches."""

    def flush(cell, part, ids, prints):
        edge = np.nonzero(np.diff(cell) | np.diff(part))[0] + 1
        starts, ends = np.r_[0, edge], np.r_[edge, len(cell)]
        hot = shared.value
        own = np.zeros(len(starts), dtype=bool)
        out = []
        if hot:
            for j, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                parts = hot.get(int(cell[s]), 1)
                if parts > 1 and part[s] // parts != part[s] % parts:
                    own[j] = True
                    out += solve_cells(ids[s:e], prints[s:e], np.array([0]), np.array([e - s]), k, block_of(ids[s:e], parts))
        return _edges(out + solve_cells(ids, prints, starts[~own], ends[~own], k))

    def local(batches):
        held: list[tuple] = []
        for b in batches:
            if b.num_rows == 0:
                continue
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), np.frombuffer(b"".join(b.column(3).to_pylist()), dtype=np.uint64).reshape(-1, WORDS)))
            cell, part = held[-1][:2]
            last = (cell == cell[-1]) & (part == part[-1])
            if last[0] and (len(held) == 1 or held[0][0][-1] == cell[-1] and held[0][1][-1] == part[-1]):
                continue  # the last cell goes on
            rows = [np.concatenate([h[i] for h in held]) for i in range(4)]
            cut = len(rows[0]) - int(last.sum())
            yield flush(*(x[:cut] for x in rows))
            held = [tuple(x[cut:] for x in rows)]
        if held:
            yield flush(*(np.concatenate([h[i] for h in held]) for i in range(4)))

    return local


def _edges(rows):
    a = np.array(rows, dtype=np.int64).reshape(len(rows), 3)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1]), pa.array(a[:, 2].astype(np.int32))], names=["a", "b", "distance"])


def components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, root): the least id that is connected with id; ids that are their own root are left out.

    Rounds of large-star and small-star (Kiveris et al. 2014), written to the shared folder each, until none changes.
    """
    e, path = save(spark, edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "components")
    last = None
    for _ in range(rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).filter("u <> v").union(least).distinct()
        new, new_path = save(spark, small, "components")
        now = new.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.countDistinct("u")).first()
        drop_path(spark, path)
        e, path = new, new_path
        if (now[0], now[1]) == last and now[0] == now[2]:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
        last = (now[0], now[1])
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _print_batches(least: int, sides_too: bool):
    def prints(batches):
        for b in slices(batches, "text"):
            found = [signed(t, least) for t in b.column(1).to_pylist()]
            columns = [b.column(0), pa.array([f for f, _ in found], type=pa.binary())]
            if not sides_too:
                yield pa.RecordBatch.from_arrays(columns, names=["id", "fp"])
                continue
            some = [m for _, m in found if m is not None]
            sides = iter(weak_sides(np.array(some)) if some else [])
            weak = [None if m is None else next(sides).tobytes() for _, m in found]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(weak, type=pa.binary())], names=["id", "fp", "weak"])

    return prints


def fingerprints(docs: DataFrame, *, id: str = "doc_id", text: str = "text", least: int = 8, sides: bool = True) -> DataFrame:
    """(id, fp) and, with ``sides``, weak, for each row with an id and a text; weak: see ``weak_sides``. Only the grid needs it."""
    narrow = docs.select(whole_id(docs, id).alias("id"), col(text).cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    return narrow.mapInArrow(_print_batches(least, sides), "id long, fp binary" + ", weak binary" * sides)


#: Pairs up to which a task compares all; beyond, its buckets of 16 bits cost less.
ALL_PAIRS = 10_000_000_000


def shares(k: int, parts: int) -> list[int]:
    """k + 1 dealt out over 2, 4, 8 ... parts, evenly at each halving: of two rows within k bits some part differs in less than its share."""
    out = [k + 1]
    while len(out) < parts:
        out = [x for s in out for x in (s // 2, s - s // 2)]
    return out


class _Links:
    """A spanning forest of the pairs that are within k bits."""

    def __init__(self, prints: np.ndarray, k: int):
        self.prints, self.k, self.root, self.kept = prints, k, np.arange(len(prints)), []

    def find(self, rows: np.ndarray) -> np.ndarray:
        root = self.root
        at = root[rows]
        while True:
            up = root[at]
            if (up == at).all():
                root[rows] = at
                return at
            at = up

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        d = _between(self.prints, a, b)
        fine = d <= self.k
        a, b, d = a[fine], b[fine], d[fine]
        while len(a):
            x, y = self.find(a), self.find(b)
            apart = x != y
            a, b, d, x, y = a[apart], b[apart], d[apart], x[apart], y[apart]
            # Each root hangs itself under one lesser root: no circle, and one edge for each that goes.
            high, at = np.unique(np.maximum(x, y), return_index=True)
            self.root[high] = np.minimum(x, y)[at]
            self.kept.append(np.stack([a[at], b[at], d[at]]).astype(np.int64))

    def edges(self) -> np.ndarray:
        return np.concatenate(self.kept, axis=1) if self.kept else np.empty((3, 0), dtype=np.int64)


def _all_pairs(links: _Links, rows: np.ndarray, others: np.ndarray, wide: int = 4096, high: int = 64) -> None:
    """Each of ``rows`` with each of ``others``: two words drop nearly all."""
    words, k = links.prints.T.copy(), links.k
    x, near = np.empty((high, wide), dtype=np.uint64), np.empty((high, wide), dtype=bool)
    d, more = np.empty((high, wide), dtype=np.uint8), np.empty((high, wide), dtype=np.uint8)
    for at in range(0, len(rows), high):
        a = rows[at : at + high]
        mine = words[:2, a]
        for to in range(0, len(others), wide):
            b = others[to : to + wide]
            s = np.s_[: len(a), : len(b)]
            np.bitwise_count(np.bitwise_xor(mine[0][:, None], words[0, b], out=x[s]), out=d[s])
            np.bitwise_count(np.bitwise_xor(mine[1][:, None], words[1, b], out=x[s]), out=more[s])
            np.less_equal(np.add(d[s], more[s], out=d[s]), k, out=near[s])
            _keep(links, near[s], a, b)


def _keep(links: _Links, near: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    n = np.count_nonzero(near)
    if n > 20_000:  # a large group: those that are together already needn't meet again
        near &= links.find(a)[:, None] != links.find(b)[None, :]
    if n:
        i, j = np.divmod(np.flatnonzero(near), near.shape[1])
        links.add(a[i], b[j])


def _by_quarters(links: _Links, a: np.ndarray, b: np.ndarray, quarters: list[int], most: int = 4_000_000) -> None:
    """The pairs of a row of ``a`` and one of ``b`` (or within ``a``, if they are the same) that are below their share in one of the quarters."""
    prints, k, same = links.prints, links.k, a is b
    in_words, in_halves, in_quarters = (shares(k, WORDS * f) for f in (1, 2, 4))
    halves, short = prints.view(np.uint32).reshape(-1, 2 * WORDS), prints.view(np.uint16).reshape(-1, 4 * WORDS)
    every, weight, count = np.arange(65_536), np.bitwise_count(np.arange(65_536)), np.arange(len(b))
    for q in quarters:
        masks, least, word = every[weight < in_quarters[q]], in_halves[q // 2], q // 4

        def sort(rows, q=q, word=word):
            rows = rows[short[rows, q].argsort(kind="stable")]
            return rows, halves[rows, q // 2], prints[rows, word], np.searchsorted(short[rows, q], np.arange(65_537))

        a_rows, a_half, a_word, a_at = sort(a)
        b_rows, b_half, b_word, b_at = (a_rows, a_half, a_word, a_at) if same else sort(b)
        b_size = np.diff(b_at)
        held, n_held = [], 0
        for v in np.flatnonzero(np.diff(a_at)).tolist():
            near = v ^ masks
            if same:
                near = near[near <= v]
            size = b_size[near]
            total = int(size.sum())
            if not total:
                continue
            there = np.repeat(b_at[near] - size.cumsum() + size, size)
            there += count[:total]
            half = b_half[there]
            step = max(1, most // total)
            for lo in range(int(a_at[v]), int(a_at[v + 1]), step):
                hi = min(int(a_at[v + 1]), lo + step)
                fits = np.bitwise_count(a_half[lo:hi, None] ^ half) < least
                if hi - lo > 1 and np.count_nonzero(fits) > 20_000:
                    fits &= links.find(a_rows[lo:hi])[:, None] != links.find(b_rows[there])[None, :]
                i, j = np.divmod(np.flatnonzero(fits), total)
                i, j = i + lo, there[j]
                fine = np.bitwise_count(a_word[i] ^ b_word[j]) < in_words[word]
                held.append((a_rows[i[fine]], b_rows[j[fine]]))
                n_held += len(held[-1][0])
                if n_held > 20_000:
                    links.add(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, n_held = [], 0
        if held:
            links.add(*(np.concatenate(x) for x in zip(*held, strict=True)))


def near_pairs(prints: np.ndarray, k: int, cut: int | None = None, share: int = 0, of: int = 1, all_pairs: int = ALL_PAIRS) -> np.ndarray:
    """(row, row, distance) in three lines: a spanning forest of the pairs within k bits, of all rows, or of a row before ``cut`` and one from it on.

    ``share`` of ``of`` parts of the work, of which each pair is in one at least. Up to ``all_pairs`` pairs, each is compared.
    """
    links, n = _Links(prints, k), len(prints)
    a = np.arange(n if cut is None else cut)
    b = a if cut is None else np.arange(cut, n)
    if len(a) == 0 or len(b) == 0:
        pass
    elif len(a) * len(b) <= all_pairs * (2 if cut is None else 1):
        size = -(-len(a) // (of * 8))  # by strips, as the first rows of a triangle meet the most
        for s in range(share, of * 8, of):
            strip = a[s * size : (s + 1) * size]
            if len(strip):
                _all_pairs(links, strip, b if cut is not None else b[strip[0] :])
    else:
        _by_quarters(links, a, b, list(range(4 * WORDS))[share::of])
    return links.edges()


def _exact_edges(heads: DataFrame, k: int, rows: int) -> DataFrame:
    """(a, b, distance): a spanning forest of the pairs of each two blocks of about ``rows`` fingerprints."""
    blocks = max(1, math.ceil(heads.count() / rows))
    of = max(1, 16 // blocks)
    pairs = [(i, j) for i in range(blocks) for j in range(i, blocks)]
    number = {p: n for n, p in enumerate(pairs)}
    tasks = [[number[min(i, j), max(i, j)] for j in range(blocks)] for i in range(blocks)]

    def spread(batches):
        for b in batches:
            own = block_of(b.column(0).to_numpy(), blocks)
            for i in np.unique(own).tolist():
                here = np.flatnonzero(own == i)
                ids, fp = b.column(0).take(pa.array(here)), b.column(1).take(pa.array(here))
                side = pa.array(np.full(len(here), i, dtype=np.int32))
                for t in tasks[i]:
                    for s in range(of):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(here), t * of + s, dtype=np.int32)), side, ids, fp], names=["task", "block", "id", "fp"])

    def solve(batches):
        held = [
            (b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), np.frombuffer(b"".join(b.column(3).to_pylist()), dtype=np.uint64).reshape(-1, WORDS))
            for b in batches if b.num_rows
        ]
        if not held:
            return
        task, block, ids, prints = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        i, j = pairs[int(task[0]) // of]
        order = block.argsort(kind="stable")
        ids, prints = ids[order], prints[order]
        a, b, d = near_pairs(prints, k, None if i == j else int((block == i).sum()), int(task[0]) % of, of)
        a, b = ids[a], ids[b]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d.astype(np.int32))], names=["a", "b", "distance"])

    rows_of_tasks = heads.select("id", "fp").mapInArrow(spread, "task int, block int, id long, fp binary")
    return rows_of_tasks.repartitionById(len(pairs) * of, F.col("task")).mapInArrow(solve, "a long, b long, distance int")


def near_edges(
    spark: SparkSession, heads: DataFrame, *, k: int = 43, tables: int | None = None, segments: int | None = None, probes: int | None = None,
    exact: bool = True, hot: int | None = None,
) -> DataFrame:
    """(a, b, distance) over distinct fingerprints (id, fp, and weak for a grid): the pairs within k bits, as spanning forests.

    All pairs, in blocks of ``hot`` rows (1,000,000), or with ``exact=False`` those that the given grid finds. Nothing that decides which
    pairs are found follows the number of rows. At most 100,000 cells of over ``hot`` rows (50,000), the largest, are split.
    """
    if exact:
        return _exact_edges(heads, k, hot or 1_000_000)
    if tables is None or segments is None or probes is None:
        raise ValueError("exact=False needs tables, segments and probes; grid(n) tells what suits n fingerprints")
    hot = hot or 50_000
    chosen = projections(tables, segments)
    crowded = heads.mapInArrow(_crowded(chosen, probes), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    split = {r[0]: math.ceil(2 * r[1] / hot) for r in crowded.filter(F.col("n") > hot).orderBy(F.desc("n"), "cell").limit(100_000).collect()}
    shared = spark.sparkContext.broadcast(split)
    cells = heads.mapInArrow(_spread(chosen, probes, shared), "cell long, part long, id long, fp binary")
    return cells.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(_local(k, shared), "a long, b long, distance int")


def near_duplicates(
    spark: SparkSession, docs: DataFrame, *, id: str = "doc_id", text: str = "text",
    k: int = 43, tables: int | None = None, segments: int | None = None, probes: int | None = None, least: int = 8, exact: bool = True, hot: int | None = None,
) -> DataFrame:
    """(doc_id, kept_doc_id): one row for each id that goes, with the least id of its group, which stays.

    A group is a connected component of pairs within k of 256 bits; all such pairs count, unless ``exact=False``. Null id or null text: in no group. Empty text and text
    without words: grouped with equal texts only; fewer than ``least`` distinct words: with texts of equal words only. Very
    long texts count whole. Ties: the least id stays. Rows that repeat an id: one document, of all those texts. Empty
    table: no rows. Extra columns don't matter. Ids must be whole numbers.
    """
    need(docs, id, text)
    prints, path = save(spark, fingerprints(docs, id=id, text=text, least=least, sides=not exact), "simhash-prints")
    heads = prints.groupBy("fp").agg(F.min("id").alias("id"), *([] if exact else [F.min_by("weak", "id").alias("weak")]))
    heads, heads_path = save(spark, heads.select(*prints.columns), "simhash-heads")
    copies = prints.join(heads.select(F.col("id").alias("b"), "fp"), "fp").select(F.col("id").alias("a"), "b").filter("a <> b")
    near = near_edges(spark, heads, k=k, tables=tables, segments=segments, probes=probes, exact=exact, hot=hot).select("a", "b")
    near, near_path = save(spark, near, "simhash-near")
    # Copies hang on their head, so the rounds see only heads; ids with two texts bring their heads together as well.
    root = components(spark, near.union(copies.join(heads.select(F.col("id").alias("a")), "a", "left_semi").select("a", "b")))
    head_root = root.select(F.col("id").alias("b"), "root")
    all_copies = copies.join(head_root, "b", "left").select(F.col("a").alias("doc_id"), F.coalesce("root", "b").alias("kept_doc_id"))
    out = all_copies.union(root.select(F.col("id").alias("doc_id"), F.col("root").alias("kept_doc_id")))
    out = out.groupBy("doc_id").agg(F.min("kept_doc_id").alias("kept_doc_id")).filter("doc_id <> kept_doc_id")
    out, _ = save(spark, out, "simhash-groups")
    for p in (path, heads_path, near_path):
        drop_path(spark, p)
    return out


def drop_near_duplicates(
    spark: SparkSession, docs: DataFrame, *, id: str = "doc_id", text: str = "text", broadcast_rows: int = 2_000_000, **how
) -> DataFrame:
    """The documents without those that near_duplicates names, with all their columns as they were.

    Of rows that are equal in id and text, one stays; rows without id or text stay, and so do different texts of one id. The ids that go are
    broadcast up to ``broadcast_rows`` of them (16 MB at the default), beyond that joined by a shuffle.
    """
    name = fresh(docs, "_gone")
    gone = near_duplicates(spark, docs, id=id, text=text, **how).select(F.col("doc_id").alias(name))
    again = docs.select(whole_id(docs, id).alias(name)).filter(F.col(name).isNotNull()).groupBy(name).count().filter("count > 1").select(name)
    again, _ = save(spark, again, "simhash-again")
    counts = gone.count(), again.count()
    gone, again = (F.broadcast(x) if n <= broadcast_rows else x for x, n in zip((gone, again), counts, strict=True))
    key = whole_id(docs, id)
    out = docs.join(gone, key == F.col(name), "left_anti")
    if counts[1]:
        one = out.join(again, key == F.col(name), "left_semi").dropDuplicates([id, text])
        out = out.join(again, key == F.col(name), "left_anti").unionByName(one)
    return out
