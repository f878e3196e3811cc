"""Documents and tables to searchable points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from taxloom import constants as C
from taxloom.functions.ids import stable_id
from taxloom.operators.chunks import chunk_documents
from taxloom.operators.tables import table_descriptions

PAYLOAD = ["document_type", "version_label", "language", "is_current", "source_site", "source_url"]


@dataclass
class Ingested:
    points: DataFrame
    stats: DataFrame


def prose_points(documents: DataFrame) -> DataFrame:
    """``path, document_type, version_label, language, is_current, source_site, source_url, text`` to points."""
    chunks = chunk_documents(documents.select("path", *PAYLOAD, "text"))
    return chunks.select(
        stable_id(F.col("document_type"), F.col("version_label"), F.lit("article"), F.col("article_number"),
                  F.col("part_index").cast("string")).alias("id"),
        "path", F.lit("prose").alias("content_kind"), *PAYLOAD, F.lit(C.JURISDICTION).alias("jurisdiction"),
        "article_number", "part_index", "references", "text", "word_count")


def table_points(tables: DataFrame, rows: DataFrame) -> DataFrame:
    """``table_ref, path, column_names`` plus payload columns, and the tables' rows, to pointer points."""
    return tables.join(table_descriptions(tables, rows), "table_ref").select(
        stable_id(F.col("document_type"), F.col("version_label"), F.lit("table"), F.col("table_ref")).alias("id"),
        "path", F.lit("table_pointer").alias("content_kind"), *PAYLOAD, F.lit(C.JURISDICTION).alias("jurisdiction"),
        "table_ref", F.col("description").alias("text"))


def ingest(documents: DataFrame, tables: DataFrame | None = None, rows: DataFrame | None = None,
           embeddings: DataFrame | None = None) -> Ingested:
    """All points of a run, with vectors joined by id where ``embeddings(id, embedding)`` are given, and
    chunk and table counts per document."""
    points = prose_points(documents)
    if tables is not None:
        points = points.unionByName(table_points(tables, rows), allowMissingColumns=True)
    else:
        points = points.withColumn("table_ref", F.lit(None).cast("string"))
    if embeddings is not None:
        points = points.join(embeddings.select("id", "embedding"), "id", "left")
    points = points.withColumn("run_ts", F.current_timestamp())
    stats = points.groupBy("path").agg(
        F.count_if(F.col("content_kind") == "prose").alias("prose_chunks"),
        F.count_if(F.col("content_kind") == "table_pointer").alias("tables"))
    return Ingested(points, stats)
