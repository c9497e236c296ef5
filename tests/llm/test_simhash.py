import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from sparlode.llm import simhash
from sparlode.llm.queries import op6_simhash
from sparlode.llm.simhash import cells_of, components, drop_near_duplicates, embed, fingerprint, fingerprints, grid, near_duplicates, near_edges, near_pairs, projections, signed, unary, weak_sides

from .conftest import prose

K = 43


def hamming(a: bytes, b: bytes) -> int:
    return (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()


def plain_print(text: str) -> int:
    """The fingerprint once more: for each bit, whether most of the distinct words' hashes have it."""
    words = re.findall(r"\w+", text.lower())
    if len(set(words)) < 8:
        w = ("\0".join(words) if words else "\1" + text).encode()
        return int.from_bytes(xxhash.xxh3_128_digest(w, seed=2) + xxhash.xxh3_128_digest(w, seed=3), "big")
    hashes = [int.from_bytes(xxhash.xxh3_128_digest(w.encode()) + xxhash.xxh3_128_digest(w.encode(), seed=1), "big") for w in set(words)]
    return sum(1 << b for b in range(256) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_bit_by_bit():
    for t in ("", "a b", "?!", many_words(3, 40), many_words(4, 301)):
        assert int.from_bytes(fingerprint(t), "big") == plain_print(t)


def groups(pairs, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def edited(text: str, share: float, seed: int) -> str:
    rng = random.Random(seed)
    words = text.split()
    for _ in range(max(1, int(len(words) * share))):
        words[rng.randrange(len(words))] = prose(rng.randrange(10**6), 1) + str(rng.randrange(1000))
    return " ".join(words)


def many_words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def test_manhattan_distance_is_a_lower_bound():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, size=(60, 32), dtype=np.uint8)
    e = embed(x).astype(int)
    for a, b in itertools.combinations(range(60), 2):
        assert np.abs(e[a] - e[b]).sum() <= hamming(x[a].tobytes(), x[b].tobytes())
    u = unary(x.view(np.uint64).reshape(60, 4))
    for a, b in itertools.combinations(range(60), 2):
        assert np.abs(e[a] - e[b]).sum() == hamming(u[a].tobytes(), u[b].tobytes())


def test_probes_are_the_neighbour_cells_on_the_uncertain_sides():
    texts = [many_words(g, 40 + g) for g in range(30)]
    prints, majorities = zip(*(signed(t) for t in texts), strict=True)
    x = np.frombuffer(b"".join(prints), dtype=np.uint8).reshape(30, -1)
    tables, segments, probes = 5, 6, 3
    chosen = projections(tables, segments)
    got = list(cells_of(x, weak_sides(np.array(majorities)), np.arange(30) == 7, chosen, probes))
    counts, weights = embed(x).astype(int), 3 ** np.arange(segments)
    for t, cells in enumerate(got):
        for i in range(30):
            home = int(counts[i][chosen[t]] @ weights) + t * 3**segments
            assert cells[i, 0] == home
            if i == 7:
                assert set(cells[i, 1:]) == {-1}
                continue
            sure = np.abs(majorities[i]).reshape(-1, 2).min(axis=1)
            rank = sorted(range(128), key=lambda s: (sure[s], s))
            for c in cells[i, 1:].tolist():  # one step from home, towards the bit of the lesser majority
                step = c - home
                s = int(chosen[t][[abs(step) == w for w in weights].index(True)])
                weak = 2 * s + int(np.abs(majorities[i])[2 * s : 2 * s + 2].argmin())
                assert (step > 0) == (majorities[i][weak] <= 0)
            levels = sorted(min(7, rank.index(int(s)) // 10) for s in chosen[t])[:probes]
            assert len(levels) == len(set(cells[i, 1:].tolist()))


def test_the_grid_grows():
    sizes = [grid(10**e) for e in range(2, 13)]
    assert sizes[0] == (12, 10, 4) and all(a <= b for x, y in itertools.pairwise(sizes) for a, b in zip(x, y, strict=True))
    assert all((3 / 8) ** s * 10**e < 100 for e, (_, s, _) in zip(range(2, 13), sizes, strict=True))


def test_every_link_by_all_pairs_in_blocks_and_in_one_cell(spark):
    rows = [(g * 10 + c, edited(many_words(g % 7, 90), 0.03 * c, g * 10 + c)) for g in range(30) for c in range(5)]
    heads = fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).dropDuplicates(["fp"]).cache()
    x = {r["id"]: r["fp"] for r in heads.collect()}
    links = [(a, b) for a, b in itertools.combinations(sorted(x), 2) if hamming(x[a], x[b]) <= K]
    for how in ({"exact": True}, {"exact": True, "hot": 40}, {"hot": 30}):
        edges = near_edges(spark, heads, **how).collect()
        assert all(hamming(x[e["a"]], x[e["b"]]) == e["distance"] <= K for e in edges)
        if "exact" in how:
            assert groups([(e["a"], e["b"]) for e in edges], x) == groups(links, x) and len(edges) < len(links)
    gone = {r["doc_id"]: r["kept_doc_id"] for r in near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), exact=True).collect()}
    prints = {i: fingerprint(t) for i, t in rows}
    assert gone == {i: r for i, r in groups([(a, b) for a, b in itertools.combinations(prints, 2) if hamming(prints[a], prints[b]) <= K], prints).items() if i != r}


def planted(n: int, k: int, seed: int) -> np.ndarray:
    """(3 n, 4) words: drawn ones, each once more with k - 1 to k + 1 bits turned anywhere, and with k // 2."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2, size=(n, 256), dtype=np.uint8)
    turned = [base]
    for counts in (rng.integers(max(0, k - 1), k + 2, size=n), np.full(n, k // 2)):
        turned.append(base ^ (rng.random((n, 256)).argsort(axis=1).argsort(axis=1) < counts[:, None]))
    return np.packbits(np.concatenate(turned), axis=1).view(np.uint64)


@pytest.mark.parametrize("k", [0, 3, 20, K, 60])
def test_near_pairs_are_those_of_all_pairs_by_any_way(k):
    x = planted(200, k, k)
    n, d = len(x), np.bitwise_count(x[:, None] ^ x[None]).sum(axis=2)
    want = groups(np.argwhere(np.triu(d <= k, 1)).tolist(), range(n))
    for all_pairs in (0, 10**10):  # by quarters, and each with each
        whole = [near_pairs(x, k, share=s, of=3, all_pairs=all_pairs) for s in range(3)]
        cut = [near_pairs(x[:250], k, all_pairs=all_pairs), near_pairs(x[250:], k, all_pairs=all_pairs) + [[250], [250], [0]], near_pairs(x, k, 250, all_pairs=all_pairs)]
        for found in (whole, cut):
            a, b, far = np.concatenate(found, axis=1)
            assert (d[a, b] == far).all() and (far <= k).all()
            assert groups(zip(a.tolist(), b.tolist(), strict=True), range(n)) == want


def test_a_large_group_by_quarters():
    rng = np.random.default_rng(4)
    x = np.packbits(rng.random((3000, 256)) < 0.04, axis=1).view(np.uint64)
    a, b, d = near_pairs(x, K, all_pairs=0)
    assert len(a) == 2999 and len(set(groups(zip(a.tolist(), b.tolist(), strict=True), range(3000)).values())) == 1 and (d <= K).all()


def test_no_link_is_lost_however_the_bits_fall(spark):
    x = planted(300, K, 9)
    rows = [(i, x[i].tobytes(), None) for i in range(len(x))]
    heads = spark.createDataFrame(rows, "id long, fp binary, weak binary")
    d = np.bitwise_count(x[:, None] ^ x[None]).sum(axis=2)
    want = groups(np.argwhere(np.triu(d <= K, 1)).tolist(), range(len(x)))
    for how in ({}, {"hot": 100}):
        edges = [tuple(e) for e in near_edges(spark, heads, **how).collect()]
        assert all(a < b and d[a, b] == n <= K for a, b, n in edges)
        assert groups([e[:2] for e in edges], range(len(x))) == want


def test_links_do_not_follow_the_size_of_the_table(spark, monkeypatch):
    monkeypatch.setattr(simhash, "grid", lambda n: (12, 10, 4) if n < 500 else (1, 20, 0))  # as if the larger table had millions of rows
    x = planted(100, K, 11)
    more = np.concatenate([x, np.random.default_rng(12).integers(0, 2**64, size=(700, 4), dtype=np.uint64)])
    found = []
    for table in (x, more):
        heads = spark.createDataFrame([(i, r.tobytes(), None) for i, r in enumerate(table)], "id long, fp binary, weak binary")
        root = groups([(e["a"], e["b"]) for e in near_edges(spark, heads).collect()], range(len(table)))
        found.append([root[i] for i in range(len(x))])
        with pytest.raises(ValueError):
            near_edges(spark, heads, exact=False)
    assert found[0] == found[1]
    given = near_edges(spark, heads, exact=False, tables=12, segments=10, probes=4).collect()
    assert 0 < len(given) and all(e["distance"] <= K for e in given)


def test_recall_of_groups_against_all_pairs(spark):
    rows, n = [], 0
    for g in range(60):
        base = many_words(g, 150)
        for c in range(1 + g % 5):
            rows.append((n, edited(base, 0.01 * c, n) if c else base))
            n += 1
    prints = {i: fingerprint(t) for i, t in rows}
    pairs = [(a, b) for a, b in itertools.combinations(range(n), 2) if hamming(prints[a], prints[b]) <= K]
    want = groups(pairs, range(n))
    got = {r["doc_id"]: r["kept_doc_id"] for r in near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(want[i] == want[r] for i, r in got.items())
    true = {i for i, r in want.items() if i != r}
    assert len(true) > 60 and len(true & set(got)) >= 0.98 * len(true)


def test_thousands_of_copies_and_chains(spark):
    base = many_words(1, 80)
    rows = [(i, base) for i in range(3000)] + [(5000 + i, many_words(10 + i, 80)) for i in range(50)]
    got = {r["doc_id"]: r["kept_doc_id"] for r in near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 for i in range(1, 3000)}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(120)]
    got = {r["id"]: r["root"] for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: r for i, r in groups(edges, {x for e in edges for x in e}).items() if i != r}
    assert components(spark, spark.createDataFrame([], "a long, b long")).collect() == []


def test_edges(spark, edge_docs, no_docs):
    got = {r["doc_id"]: r["kept_doc_id"] for r in near_duplicates(spark, edge_docs).collect()}
    assert got == {}  # the text that doc 4 shares is that of a row without an id
    kept = drop_near_duplicates(spark, edge_docs)
    assert kept.schema == edge_docs.schema
    assert kept.count() == edge_docs.count() - 1  # of the rows that repeat id 8 and its text one stays
    assert sum(r["doc_id"] == 8 for r in kept.collect()) == 1
    assert near_duplicates(spark, no_docs).collect() == [] and drop_near_duplicates(spark, no_docs).collect() == []
    ties = spark.createDataFrame([(3, "a b"), (2, "A, B!"), (1, "b a"), (4, ""), (5, ""), (6, None), (7, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["kept_doc_id"] for r in near_duplicates(spark, ties).collect()} == {3: 2, 5: 4}


def test_query(spark, sf, documents):
    rows = {r["doc_id"]: fingerprint(r["text"]) for r in documents.collect()}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(rows), 2) if hamming(rows[a], rows[b]) <= K]
    want = {i: r for i, r in groups(pairs, rows).items() if i != r}
    got = {r["doc_id"]: r["kept_doc_id"] for r in op6_simhash(spark, sf).collect()}
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want)


def test_recall_by_distance(spark):
    heads = fingerprints(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).dropDuplicates(["fp"]).cache()
    x = {r["id"]: np.frombuffer(r["fp"], dtype=np.uint64) for r in heads.collect()}
    ids, m = np.array(list(x)), np.array(list(x.values()))
    links = []
    for i in range(len(m)):
        d = np.bitwise_count(m[i] ^ m[i + 1 :]).sum(axis=1)
        links += [(int(ids[i]), int(ids[i + 1 + j]), int(d[j])) for j in np.nonzero(d <= K)[0]]
    root = groups([(e["a"], e["b"]) for e in near_edges(spark, heads).collect()], x)
    assert len(links) > 1000
    for low, high, least in ((0, 30, 0.999), (31, 38, 0.99), (39, 43, 0.97)):
        part = [(a, b) for a, b, d in links if low <= d <= high]
        assert sum(root[a] == root[b] for a, b in part) >= least * len(part)


def test_recall_of_copies_by_their_texts(spark):
    def grams(t):
        w = t.split()
        return set(zip(w, w[1:], w[2:], strict=False))

    rows = []
    for g in range(300):
        base = many_words(g, 150)
        rows += [(2 * g, base), (2 * g + 1, edited(base, 0.08, g))]
    near = {2 * g + 1 for g in range(300) if len((a := grams(rows[2 * g][1])) & (b := grams(rows[2 * g + 1][1]))) >= 0.5 * len(a | b)}
    got = {r["doc_id"]: r["kept_doc_id"] for r in near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r == i - 1 for i, r in got.items())
    assert len(near) > 200 and len(near & set(got)) >= 0.9 * len(near)


def test_ids_must_be_whole_numbers_and_one_id_may_have_two_texts(spark):
    with pytest.raises(ValueError):
        near_duplicates(spark, spark.createDataFrame([("doc-a", "x")], "doc_id string, text string"))
    rows = [(1, many_words(1, 50)), (1, many_words(2, 50)), (1, many_words(2, 50)), (2, many_words(3, 50))]
    assert sorted(drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id int, text string")).collect()) == sorted(set(rows))
