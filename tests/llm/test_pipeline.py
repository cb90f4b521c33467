import public_tokenizers
import tiktoken

import corpus_pipeline
from foliospark.llm import bpe
from tests.llm.test_decontaminate import brute as benchmark_hits
from tests.llm.test_lines_and_licences import brute_lines
from tests.llm.test_near_duplicates import brute as components

SF = "/root/testdata/sf0.001"


def test_each_stage_on_what_the_one_before_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
        docs = stage(spark, docs, SF)
        docs.write.parquet(path := str(tmp_path / name))
        docs = spark.read.parquet(path)
        if name != "byte-level BPE":
            assert docs.columns == columns
        seen[name] = (before, docs.collect())
    before, after = seen["quality classifier"]
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    assert sum(i in kept for i, *_ in before if good.get(i) == 1) >= 0.7 * sum(good.get(i) == 1 for i, *_ in before)
    before, after = seen["line dedup"]
    assert {(r.doc_id, r.text) for r in after} == set(brute_lines(before, 8))
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = seen["n-gram Jaccard join"]
    assert {r.doc_id for r in after} == {c for _, _, _, c in components(before)}
    before, after = seen["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = {i: benchmark_hits(t, items, 10) for i, t, *_ in before}
    assert {r.doc_id for r in after} == {i for i, (n, h, _) in hits.items() if h <= 0.5 * n}
    assert {r.doc_id: r.text for r in after if not hits[r.doc_id][1]} == {i: t for i, t, *_ in before if not hits[i][1]}
    before, after = seen["byte-level BPE"]
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    assert {r.doc_id: r.ids for r in after} == {i: encoding.encode_ordinary(t or "") for i, t, *_ in before}
