import json

import pytest

from foliospark import api
from foliospark.config import RunConfig
from foliospark.operators import audit
from foliospark.sources import sinks, typeset
from foliospark.streaming.ingest import stream_documents


@pytest.fixture(scope="module")
def some(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 25")
    return docs, typeset.objects(docs).cache(), typeset.pages(docs).cache()


def test_parsed_tables_hold_their_invariants(some):
    _, objects, pages = some
    tables = api.parse_objects(objects, pages)
    assert api.check(tables, objects, pages).isEmpty()
    broken = {**tables, "ledger": tables["ledger"].where("doc_id != 3")}
    found = api.check(broken, objects, pages)
    assert {(r.doc_id, r.check) for r in found.collect()} == {(3, "ledger")}
    with pytest.raises(audit.InvariantError):
        audit.require_none(found)


def test_furniture_stays_with_off(some):
    _, objects, pages = some
    off, drop = (api.parse_objects(objects, pages, RunConfig(page_furniture=m))["elements"].count() for m in ("off", "drop"))
    assert off > drop


def test_result_and_publish(spark, some, tmp_path):
    _, objects, pages = some
    tables = api.parse_objects(objects, pages)
    result = sinks.result_json(tables["elements"].select("doc_id", "ord", "type", "text"), pages.select("doc_id", "page", "width", "height")).where("doc_id = 2").first()
    parsed = json.loads(result.result)
    assert [e["ord"] for e in parsed["elements"]] == list(range(1, len(parsed["elements"]) + 1)) and parsed["pages"][0]["width"] == 595.0
    path = str(tmp_path / "out")
    sinks.publish(spark, {"pages": pages}, path)
    with pytest.raises(FileExistsError):
        sinks.publish(spark, {"pages": pages}, path)
    sinks.publish(spark, {"pages": pages.limit(3)}, path, replace=True)
    assert spark.read.parquet(f"{path}/pages").count() == 3 and [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["out"]


def test_two_runs_agree_whatever_the_partitions(spark, some):
    docs, objects, pages = some
    one = api.parse_objects(objects, pages)["elements"].select("doc_id", "obj_id", "ord", "type")
    spread = docs.repartition(7)
    two = api.parse_objects(typeset.objects(spread), typeset.pages(spread))["elements"].select("doc_id", "obj_id", "ord", "type")
    assert audit.difference(one, two).isEmpty()


def test_options_are_checked():
    assert RunConfig.of({"debug": True}).digest != RunConfig().digest
    for bad in ({"page_furniture": "no"}, {"debug": 1}, {"other": True}):
        with pytest.raises((ValueError, TypeError)):
            RunConfig.of(bad)


def test_missing_fields(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, None, None), (3, "x", "y")], "doc_id bigint, title string, author string")
    assert sorted(tuple(r) for r in audit.missing_fields(rows, ["title", "author"]).collect()) == [(1, "author"), (2, "author"), (2, "title")]


def test_stream_gives_what_a_batch_gives(spark, some, tmp_path):
    docs, objects, pages = some
    docs.select("doc_id", "text", "source").write.parquet(str(tmp_path / "in"))
    stream_documents(spark, str(tmp_path / "in"), "doc_id bigint, text string, source string", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {(r.doc_id, r.markdown) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.doc_id, r.markdown) for r in api.to_markdown(api.parse_objects(objects, pages)).collect()}
