import base64
import random

import pytest
import tiktoken

from sparlode.llm.bpe import PATTERN, Encoder, bpe_decode, bpe_encode, read_vocabulary, splits

FILES = ["/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"]


@pytest.fixture(scope="module", params=FILES)
def both(request):
    tokens = read_vocabulary(request.param)
    ranks = {t: i for i, t in enumerate(tokens)}
    return Encoder(tokens, splits(tokens)), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def naive(ranks, data):
    parts = [data[k : k + 1] for k in range(len(data))]
    while len(parts) > 1:
        r, k = min((ranks.get(parts[k] + parts[k + 1], 1 << 40), k) for k in range(len(parts) - 1))
        if r == 1 << 40:
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[p] for p in parts]


def test_same_ids_as_another_encoder(both):
    ours, theirs = both
    rng = random.Random(7)
    pieces = ["a", "b", "the", "th", "é", " ", "  ", "\n", "ing", "!", "1", "漢", "😀", "'s", "'LL", "er", "on", "ö", "́", "\x00", "ſ", "²"]
    for _ in range(2000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))
        assert ours.encode(text) == theirs.encode_ordinary(text)
        assert ours.decode(ours.encode(text)) == text


def test_short_words_together_are_those_of_the_automaton(both):
    ours, theirs = both
    rng = random.Random(5)
    pieces = [*"etaoinshr", " ", "th", "he", "ing", "é", "漢", "😀", "!!", "--", "  ", "0", "\x00"]
    words = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 16))) for _ in range(5000)]
    data = [d for w in ("a", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "a" * 32, *words) if len(d := w.encode()) <= 32]
    assert ours.short_pieces(data) == [tuple(ours.piece(d)) for d in data] and ours.short_pieces([]) == []
    texts = [*words, None, "", "x" * 5000, " ".join(words)]
    for _ in range(2):  # unknown and known
        assert ours.encode_all(texts) == [None if t is None else theirs.encode_ordinary(t) for t in texts]
    assert max(map(len, ours.words)) <= 64


def test_prefixes_of_words_without_end(both):
    ours, theirs = both
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgéthn") for _ in range(30_000))
    assert ours.encode(text) == theirs.encode_ordinary(text)
    assert ours.piece(b"a" * 4097) == theirs.encode_ordinary("a" * 4097)


def test_pair_test_is_that_of_merging_by_rank(both):
    ours, _ = both
    ranks = {t: i for i, t in enumerate(ours.tokens)}
    rng = random.Random(2)
    for _ in range(3000):
        p, t = rng.randrange(len(ranks)), rng.randrange(600 if rng.random() < 0.5 else len(ranks))
        assert ours.compatible(p, t) == (naive(ranks, ours.tokens[p] + ours.tokens[t]) == [p, t])


def test_tiny_vocabulary_and_missing_bytes(tmp_path):
    tokens = [b"a", b"b", b"ab", b"aba", b"bb"]
    (tmp_path / "v").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    e = Encoder(read_vocabulary(str(tmp_path / "v")), splits(tokens), None)
    ranks = {t: i for i, t in enumerate(tokens)}
    for n in range(1, 9):
        for k in range(1 << n):
            text = "".join("ab"[k >> i & 1] for i in range(n))
            assert e.encode(text) == naive(ranks, text.encode())
    with pytest.raises(ValueError):
        e.encode("abc")


def test_columns(spark, edge_docs, no_docs):
    out = bpe_encode(spark, edge_docs, check="same").collect()
    assert len(out) == 14 and all((r["ids"] is None) == (r["text"] is None) == (r["same"] is None) for r in out)
    assert all(r["same"] for r in out if r["text"] is not None) and [r["ids"] for r in out if r["text"] == ""] == [[]]
    back = bpe_decode(spark, bpe_encode(spark, edge_docs).drop("text"))
    key = lambda r: repr(sorted(r.asDict().items(), key=str))
    assert sorted(map(key, back.collect())) == sorted(map(key, edge_docs.collect()))
    assert bpe_encode(spark, no_docs).collect() == []
    clash = bpe_encode(spark, edge_docs.withColumnRenamed("fp", "Round_Trip"), ids="ID", check="round_trip")
    assert clash.columns[-2:] == ["ID_", "round_trip_"] and all(r["round_trip_"] for r in clash.collect() if r["text"] is not None)


def test_whole_table(spark, documents):
    tokens = read_vocabulary(FILES[0])
    theirs = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    from sparlode.llm.queries import op3_bpe

    path = documents.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    got = {r["doc_id"]: r for r in op3_bpe(spark, path).collect()}
    rows = documents.collect()
    assert len(got) == len(rows) and all(r["round_trip"] for r in got.values())
    assert all(list(got[r["doc_id"]]["ids"]) == theirs.encode_ordinary(r["text"]) for r in rows)
