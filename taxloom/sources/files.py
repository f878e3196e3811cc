"""Routing of files by extension, text documents, and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Which extension is read as what.
ROUTES = {".xml": "ubl_xml", ".csv": "csv", ".txt": "text", ".md": "text"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def route(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``path`` rows split into (path, format) and rejects with a reason."""
    ext = extension(F.col("path"))
    known = F.coalesce(*[F.when(ext == e, f) for e, f in ROUTES.items()])
    marked = files.withColumn("format", known)
    accepted = marked.filter(F.col("format").isNotNull())
    rejected = marked.filter(F.col("format").isNull()).drop("format").withColumn(
        "reason", F.concat(F.lit("unsupported file type "), F.when(ext == "", "(none)").otherwise(ext)))
    return accepted, rejected


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths and sizes under a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def read_texts(spark: SparkSession, paths) -> DataFrame:
    """Whole text files; bytes that are not UTF-8 read as replacement characters."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of sources, with the defaults for version and currency."""
    schema = ("path string, document_type string, language string, version_label string, is_current boolean, "
              "source_site string, source_url string")
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumns({
        "version_label": F.coalesce("version_label", F.lit("current")),
        "is_current": F.coalesce("is_current", F.lit(True))})


def join_manifest(manifest: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifest entries with their file (the path itself or its last parts; of several the shortest path), and entries without one."""
    name = lambda c: F.regexp_extract(c, r"[^/]*$", 0)
    f = files.withColumnRenamed("path", "file_path").withColumn("name", name(F.col("file_path")))
    m = manifest.withColumn("name", name(F.col("path")))
    ends = (F.col("file_path") == F.col("path")) | F.col("file_path").endswith(F.concat(F.lit("/"), F.ltrim(F.col("path"), F.lit("/"))))
    nearest = Window.partitionBy("path").orderBy(F.length("file_path"), "file_path")
    joined = m.join(f, "name").filter(ends).withColumn("_n", F.row_number().over(nearest)).filter(F.col("_n") == 1).drop("name", "_n")
    absent = manifest.join(joined.select("path").distinct(), "path", "left_anti").withColumn("reason", F.lit("file not found"))
    return joined, absent
