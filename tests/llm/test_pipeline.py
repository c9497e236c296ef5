import itertools

import corpus_pipeline
import numpy as np
import tiktoken

import __spark_entry__
from sparlode.llm.bpe import PATTERN, read_vocabulary
from sparlode.llm.mixing import LEAST_KEPT, _hashes, inclusion, tokens_of
from sparlode.llm.quality import D, estimate
from sparlode.llm.secret_scan import redact, scan

from .test_mixing import plain_sample, sums_of
from .test_quality import plain_statistics
from .test_simhash import K, groups, plain_print


def key(rows):
    return sorted(map(repr, rows))


def test_every_stage_by_hand(spark):
    sf = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "secret scans", "mixing", "bpe"]
    docs, rows = documents, documents.collect()
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    results = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if n < 4:
            assert out.columns == documents.columns
        out.write.mode("overwrite").parquet(f"{root}/stage-{n}")
        results[name] = (docs, rows, out := spark.read.parquet(f"{root}/stage-{n}"), out.collect())
        docs, rows = out, results[name][3]
    docs, before, _, after = results["quality rules"]
    params = {(r["lang"], r["source"]): r["params"] for r in estimate(spark, docs).collect()}

    def far(r) -> bool:
        p = params[r["lang"], r["source"]]
        if p is None or not r["text"].split():
            return False
        z = np.array(plain_statistics(r["text"])) - p[:D]
        return z @ np.array(p[D:-1]).reshape(D, D) @ z > p[-1]

    assert key(after) == key(r for r in before if not far(r)) and len(after) < len(before)
    _, before, _, after = results["near-dedup"]
    prints = {r["doc_id"]: plain_print(r["text"]) for r in before}
    root = groups([(a, b) for a, b in itertools.combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= K], prints)
    # All pairs: what stays is one of each group; of small tables the grid finds all links.
    assert key(after) == key(r for r in before if root[r["doc_id"]] == r["doc_id"]) and len(after) < len(before)
    _, before, _, after = results["secret scans"]
    assert sorted((r["doc_id"], redact(r["text"])) for r in before) == sorted((r["doc_id"], r["text"]) for r in after)
    leaks = [r["text"][s[0] : s[1]] for r in before for _, s, _, _ in scan(r["text"])]
    assert leaks and not any(x in r["text"] for x in leaks for r in after)
    docs, before, _, after = results["mixing"]
    units = [(*r[-2:], r["source"], tokens_of(r["text"]), 1, r["doc_id"]) for r in docs.select("*", *_hashes(docs)).collect()]
    stays = plain_sample(units, inclusion(sums_of(units), least=LEAST_KEPT), 100_000)
    assert key(after) == key(r for r in before if r["doc_id"] in stays)
    _, before, _, after = results["bpe"]
    tokens = read_vocabulary("/opt/tokenizers/byte_bpe_50k.tiktoken")
    theirs = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    assert {r["doc_id"]: list(r["ids"]) for r in after} == {r["doc_id"]: theirs.encode_ordinary(r["text"]) for r in before}
    assert all(r["round_trip"] for r in after)


def test_run_is_the_stages_in_turn(spark, sf):
    q = __spark_entry__.queries()
    assert q["pipeline"] is corpus_pipeline.run and [x for x in q if x.startswith("op")] and len([x for x in q if x.startswith("op")]) == 10
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and len({r["doc_id"] for r in rows}) == len(rows)


def test_empty_and_edges(spark, edge_docs, tmp_path):
    for name, docs in (("edge", edge_docs), ("none", edge_docs.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert "text" not in out.columns and "ids" in out.columns
        assert out.count() == 0 if name == "none" else 0 < out.count() <= 14


def test_columns_that_clash_with_those_of_the_stages(spark, documents, tmp_path):
    names = ["ids", "round_trip", "fp", "weak", "k1", "k2", "copies", "taken", "left", "cell", "_group_params", "_mix_1", "n_tokens"]
    docs = documents.selectExpr("*", *(f"{i} AS `{n}`" for i, n in enumerate(names)))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [c for c in docs.columns if c != "text"] + ["ids_", "round_trip_"]
    assert all(r["round_trip_"] and all(r[n] == i for i, n in enumerate(names)) for r in out.collect())
