"""Writers of reader state and citations, and checks of an index's age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.state import TABLES, live
from ..storage import folders

STALE_MS = 12 * 60 * 60 * 1000


def write_state(document: dict, path: str) -> None:
    """A state document as JSON: a folder of lines for each table, tombstones included, and one for the rest."""
    spark = next(document[n] for n in TABLES if document.get(n) is not None).sparkSession
    for name in TABLES:
        if document.get(name) is not None:
            document[name].write.json(f"{path}/{name}")
    spark.createDataFrame([(1, document.get("updated_at", 0))], "schema int, updated_at long").coalesce(1).write.json(f"{path}/document")


def read_state(spark, path: str, schemas: dict) -> dict:
    """A state document that ``write_state`` wrote; tables that are absent are left out, as an older build wrote none."""
    about = spark.read.schema("schema int, updated_at long").json(f"{path}/document").first()
    if about is None or about["schema"] != 1:
        raise ValueError(f"{path} is no state of schema 1")
    present = folders(spark, path)
    return {n: spark.read.schema(s).json(f"{path}/{n}") for n, s in schemas.items() if n in present} | {"updated_at": about["updated_at"]}


def citations(entries: DataFrame, papers: DataFrame) -> DataFrame:
    """(paper_id, entry): citation entries of a live library, of the papers that are known."""
    c = F.col
    known = live(entries).select("paper_id").join(papers, F.col("paper_id") == F.col("id"))
    return known.select("paper_id", tx.bibtex(c("id"), c("title"), c("authors"), c("published"), c("categories")).alias("entry"))


def write_citations(entries: DataFrame, papers: DataFrame, path: str) -> None:
    citations(entries, papers).select("entry").write.option("lineSep", "\n\n").text(path)


def is_stale(built_at_ms: Column, now_ms: Column) -> Column:
    return now_ms - built_at_ms > STALE_MS


def has_moved(before: DataFrame | None, after: DataFrame) -> bool:
    """Whether two manifests tell of different builds; without a usable first one there is only to gain."""
    row = before.select("built_at").first() if before is not None else None
    return row is None or row["built_at"] is None or row["built_at"] != after.select("built_at").first()["built_at"]
