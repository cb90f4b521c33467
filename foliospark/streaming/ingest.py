"""Files that keep arriving: each micro-batch goes through the same functions as a batch run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import assembly
from ..sources import typeset


def stream_documents(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Markdown of text rows (doc_id, text, source) as Parquet files with them arrive below ``path``.

    A micro-batch that is run again after a failure writes to the same folder of its number, so each document appears once.
    """

    def write(batch: DataFrame, number: int) -> None:
        objects, pages = typeset.objects(batch), typeset.pages(batch)
        flow = assembly.ordered(assembly.classified(objects, pages))
        assembly.markdown_documents(flow).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
