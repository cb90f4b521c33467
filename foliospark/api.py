"""Documents in, tables out: the stages in order over any source of objects and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .config import RunConfig
from .operators import assembly, audit, furniture, probes
from .sources import pdf


def parse_objects(objects: DataFrame, pages: DataFrame, config: RunConfig | None = None) -> dict[str, DataFrame]:
    """elements (in order, with parents), furniture, page probes, continuations, ledger of source objects."""
    config = config or RunConfig()
    flow = assembly.ordered(assembly.classified(objects, pages, keep_furniture=config.page_furniture == "off"))
    tree = assembly.heading_parents(flow).select("doc_id", "obj_id", "parent_id")
    return {
        "elements": flow.join(tree, ["doc_id", "obj_id"]),
        "furniture": furniture.clusters(objects, pages),
        "page_probes": probes.page_types(objects, pages),
        "continuations": furniture.continuations(objects, pages),
        "ledger": assembly.ledger(objects, pages),
    }


def parse_pdf(spark: SparkSession, path: str, config: RunConfig | None = None) -> dict[str, DataFrame]:
    """All tables for the files below ``path``, with source objects, pages and warnings."""
    scanned = pdf.scan(spark, path)
    objects, pages = pdf.objects(scanned), pdf.pages(scanned)
    return {"objects": objects, "pages": pages, "warnings": pdf.warnings(scanned), **parse_objects(objects, pages, config)}


def to_markdown(tables: dict[str, DataFrame]) -> DataFrame:
    """doc_id, markdown of each document."""
    return assembly.markdown_documents(tables["elements"])


def check(tables: dict[str, DataFrame], objects: DataFrame, pages: DataFrame) -> DataFrame:
    """Violations of the invariants by parsed tables."""
    return audit.run_all(objects, pages, tables["elements"], tables["ledger"])
