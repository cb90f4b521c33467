"""Writing results: one JSON document a file, tables, and a publish step that shows all or nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def result_json(elements: DataFrame, pages: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """doc_id, result: elements in order, pages and warnings of each document as one JSON string."""
    listed = lambda frame, name, key: frame.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(key, *[c for c in frame.columns if c not in ("doc_id", key)]))).alias(name))
    whole = listed(pages, "pages", "page").join(listed(elements, "elements", "ord"), "doc_id", "left")
    if warnings is not None:
        whole = whole.join(listed(warnings, "warnings", "code"), "doc_id", "left")
    return whole.select("doc_id", F.to_json(F.struct(*[c for c in whole.columns if c != "doc_id"])).alias("result"))


def publish(spark: SparkSession, tables: dict[str, DataFrame], path: str, replace: bool = False) -> None:
    """Write tables below a staging folder, check that all are there, then rename it to ``path``.

    A path that exists is kept unless ``replace``; then it is set aside and comes back if the rename fails.
    """
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path
    target, staging, aside = at(path), at(f"{path}.staging-{uuid.uuid4().hex[:8]}"), at(f"{path}.old-{uuid.uuid4().hex[:8]}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if target.isRoot() or fs.exists(target) and not replace:
        raise FileExistsError(path)
    try:
        for name, frame in tables.items():
            frame.write.parquet(f"{staging.toString()}/{name}")
        for name in tables:
            if not fs.exists(at(staging, f"{name}/_SUCCESS")):
                raise OSError(f"{name} was not written")
        had = fs.exists(target)
        if had:
            fs.rename(target, aside)
        if not fs.rename(staging, target):
            if had:
                fs.rename(aside, target)
            raise OSError(f"cannot rename to {path}")
        if had:
            fs.delete(aside, True)
    finally:
        fs.delete(staging, True)
