"""The registered queries: SQL where there is some, else the shape of the result, on the smallest tables."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from foliospark.llm import queries

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent.parent
COLUMNS = {
    "op1_quality": {"doc_id", "held_out", "score", "predicted"},
    "op2_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op3_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op5_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op7_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op8_ngram_join": {"doc_id", "n_shingles", "component_id"},
    "op9_jump_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op10_decontaminate": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame, sql = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    columns = sorted(frame.columns)
    assert columns == sorted(sql.columns)
    at = [sql.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in frame.collect()) == sorted(tuple(r[i] for i in at) for r in sql.fetchall())


@pytest.mark.parametrize("name", sorted(set(COLUMNS) - set(queries.oracle_sql())))
def test_one_row_a_document(spark, name):
    frame = queries.queries()[name](spark, SF)
    assert set(frame.columns) >= COLUMNS[name]
    assert sorted(r.doc_id for r in frame.collect()) == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


def test_the_rest_imports_without_this_subpackage(tmp_path):
    (tmp_path / "foliospark").mkdir()
    for p in (ROOT / "foliospark").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "foliospark" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') for n in e.queries()); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
