"""Stored tables: keyed snapshots, replace-all partitions, appends.

Plain Parquet has no row updates, so an update is "old joined with new, written as the next
snapshot"; each function returns the new content and leaves writing to ``merge_snapshot``, which rewrites only
the buckets that hold a changed key, or to the caller.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from taxloom import constants as C

REGISTRY = ("table_ref string, document_type string, version_label string, jurisdiction string, language string, "
            "is_current boolean, effective_start_date string, effective_end_date string, description string, "
            "corrected boolean, corrected_date string, source_site string, source_url string, created_at timestamp")
_KEPT = ("description", "corrected", "corrected_date", "created_at")


def last_per_key(updates: DataFrame, *keys: str, order: str | None = None) -> DataFrame:
    """One update per key: the latest by ``order`` where there is such a column, ties and all else by the greatest values, so that
    several updates of one key never multiply the row they change."""
    rest = [c for c in updates.columns if c not in keys]
    first = [F.desc(order)] if order and order in rest else []
    w = Window.partitionBy(*keys).orderBy(*first, *[F.desc(F.col(c).cast("string")) for c in rest])
    return updates.withColumn("_last", F.row_number().over(w)).filter(F.col("_last") == 1).drop("_last")


def upsert_registry(old: DataFrame, new: DataFrame, now: Column | None = None) -> DataFrame:
    """Registers tables by ``table_ref``: new values win, while description, correction marks and the time of
    first registration survive."""
    now = F.current_timestamp() if now is None else now
    keys = [f.name for f in old.schema.fields]
    n = last_per_key(new, "table_ref", order="created_at").select("table_ref", F.lit(True).alias("given"), *[F.col(c).alias(f"new_{c}") for c in new.columns if c != "table_ref"])
    both = old.join(n, "table_ref", "full_outer")

    def value(c: str) -> Column:
        if c == "table_ref":
            return F.col(c)
        if c == "created_at":
            return F.coalesce(F.col(c), now)
        if c == "corrected":
            return F.coalesce(F.col(c), F.lit(False))
        if c in _KEPT:
            return F.col(c)
        default = {"jurisdiction": F.lit(C.JURISDICTION), "is_current": F.lit(True)}.get(c, F.lit(None))
        incoming = F.coalesce(F.col(f"new_{c}"), default) if c in new.columns else default
        return F.when(F.col("given"), incoming).otherwise(F.col(c))

    return both.select(*[value(c).cast(old.schema[c].dataType).alias(c) for c in keys])


def set_descriptions(registry: DataFrame, descriptions: DataFrame) -> DataFrame:
    d = last_per_key(descriptions, "table_ref", order="set_at").select("table_ref", F.col("description").alias("new_description"))
    return registry.join(d, "table_ref", "left").withColumn("description", F.coalesce("new_description", "description")).select(*registry.columns)


def mark_corrected(registry: DataFrame, corrections: DataFrame) -> DataFrame:
    """``corrections(table_ref, corrected_date)``."""
    c = last_per_key(corrections, "table_ref", order="corrected_date").select("table_ref", F.col("corrected_date").alias("new_date"))
    hit = F.col("new_date").isNotNull()
    return registry.join(c, "table_ref", "left").withColumns({
        "corrected": F.when(hit, True).otherwise(F.col("corrected")),
        "corrected_date": F.coalesce("new_date", "corrected_date")}).select(*registry.columns)


def registry_entry(registry: DataFrame, table_ref: str) -> DataFrame:
    return registry.filter(F.col("table_ref") == table_ref)


def list_tables(registry: DataFrame, document_type: str | None = None) -> DataFrame:
    return registry.filter(F.col("document_type") == document_type) if document_type else registry


def replace_table_rows(rows: DataFrame, path: str) -> None:
    """Replaces all rows of the tables present in ``rows``; other tables' folders are left alone."""
    rows.repartition("table_ref").sortWithinPartitions("table_ref", "row_index").write.partitionBy("table_ref").option(
        "partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_table_rows(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def upsert_chunks(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Points by stable id, last run wins (``run_ts``; of one run the greater ``text``, so the winner is always the same); ids no longer
    produced stay, as documents may shrink."""
    both = stored.unionByName(fresh, allowMissingColumns=True)
    w = Window.partitionBy("id").orderBy(F.desc("run_ts"), *([F.desc("text")] if "text" in both.columns else []))
    return both.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def new_batches(rows: DataFrame, now: Column | None = None, ttl_hours: int = C.BATCH_TTL_HOURS) -> DataFrame:
    """``user_id, kind, status, data`` as batches with an id and an expiry."""
    now = F.current_timestamp() if now is None else now
    return rows.withColumns({
        "batch_id": F.expr("uuid()"), "created_at": now,
        "expires_at": now + F.make_dt_interval(hours=F.lit(ttl_hours))})


def update_batches(batches: DataFrame, updates: DataFrame) -> DataFrame:
    """``updates(batch_id, user_id, status, data)``; an update by anyone but the owner changes nothing."""
    u = last_per_key(updates, "batch_id", "user_id", order="updated_at").select("batch_id", "user_id", F.col("status").alias("new_status"), F.col("data").alias("new_data"), F.lit(True).alias("hit"))
    return batches.join(u, ["batch_id", "user_id"], "left").withColumns({
        "status": F.when(F.col("hit"), F.col("new_status")).otherwise(F.col("status")),
        "data": F.when(F.col("hit"), F.col("new_data")).otherwise(F.col("data"))}).select(*batches.columns)


def _place(spark, path: str):
    """The Hadoop path and its file system, for the few calls that look at names and never at rows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _manifests(spark, folder: str) -> list[int]:
    """The versions that are complete, in order; there are never more than a few."""
    place, fs = _place(spark, f"{folder}/manifests")
    if not fs.exists(place):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(place)]
    return sorted(int(n[2:-5]) for n in names if n.startswith("v=") and n.endswith(".json"))


def read_manifest_of(spark, folder: str, version: int) -> dict:
    """What version ``version`` consists of: the schema, the number of buckets, and per bucket the version that wrote it."""
    row = spark.read.text(f"{folder}/manifests/v={version:012d}.json", wholetext=True).first()
    return json.loads(row.value)


def _write_manifest(spark, folder: str, version: int, manifest: dict) -> None:
    """Under another name first, then renamed, so that a manifest is there whole or not at all."""
    target, fs = _place(spark, f"{folder}/manifests/v={version:012d}.json")
    draft, _ = _place(spark, f"{folder}/manifests/.draft-{version}")
    fs.mkdirs(draft.getParent())
    out = fs.create(draft, True)
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()
    if not fs.rename(draft, target):
        raise OSError(f"could not name manifest {version} of {folder}")


def _bucket_path(folder: str, bucket: int | str, version: int) -> str:
    return f"{folder}/data/v={version:012d}/bucket={bucket}"


def _read_buckets(spark, folder: str, manifest: dict, buckets) -> DataFrame:
    schema = T.StructType.fromJson(manifest["schema"])
    paths = [_bucket_path(folder, b, manifest["live"][b]) for b in buckets if b in manifest["live"]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge_snapshot(batch: DataFrame, folder: str, version: int, keys: list[str], merge: Callable[[DataFrame | None, DataFrame], DataFrame],
                   buckets: int = 64) -> bool:
    """Makes ``version`` of a keyed table from the newest one and ``batch``; false where that version is there already.

    Rows lie in buckets by the hash of ``keys``. Only the buckets that hold a key of the batch are read, merged
    (``merge(old rows or None, batch)``, which keeps the keys of its rows) and written; a manifest names, for every bucket, the
    version that wrote it. So a batch costs what its buckets hold. The number of buckets is settled by the first version; choose
    it so that one bucket fits a task, and ``rebucket`` a table that has outgrown it. The newest two versions stay readable,
    buckets that neither names are deleted. A version that failed half-way has no manifest and is written again.
    """
    spark = batch.sparkSession
    versions = _manifests(spark, folder)
    if versions and versions[-1] >= version:
        return False
    old = read_manifest_of(spark, folder, versions[-1]) if versions else {"buckets": buckets, "live": {}}
    held = batch.storageLevel.useMemory or batch.storageLevel.useDisk
    rows = batch if held else batch.persist()  # read for its buckets, then for the merge
    try:
        return _merge(rows, folder, version, keys, merge, versions, old)
    finally:
        if not held:
            rows.unpersist()


def _merge(batch: DataFrame, folder: str, version: int, keys: list[str], merge, versions: list[int], old: dict) -> bool:
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(old["buckets"])).cast("string")
    touched = sorted(r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect())  # at most the number of buckets
    live = dict(old["live"])
    schema = old.get("schema")
    if touched or schema is None:
        merged = merge(_read_buckets(spark, folder, old, touched) if schema else None, batch)
        schema = merged.schema.jsonValue()
        data = f"{folder}/data/v={version:012d}"
        merged.withColumn("bucket", bucket).repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
        place, fs = _place(spark, data)
        written = {status.getPath().getName() for status in fs.listStatus(place)}
        live = {b: v for b, v in live.items() if b not in touched} | {b: version for b in touched if f"bucket={b}" in written}
    _write_manifest(spark, folder, version, {"buckets": old["buckets"], "schema": schema, "live": live})
    _forget(spark, folder, versions + [version])
    return True


def _forget(spark, folder: str, versions: list[int], keep: int = 2) -> None:
    """Deletes the manifests before the newest ``keep`` and the buckets that only they name."""
    kept = {pair for v in versions[-keep:] for pair in read_manifest_of(spark, folder, v)["live"].items()}
    for v in versions[:-keep]:
        for pair in read_manifest_of(spark, folder, v)["live"].items():
            if pair not in kept:
                place, fs = _place(spark, _bucket_path(folder, *pair))
                fs.delete(place, True)
        place, fs = _place(spark, f"{folder}/manifests/v={v:012d}.json")
        fs.delete(place, False)


def rebucket(spark, folder: str, target: str, keys: list[str], buckets: int) -> None:
    """The newest version written to another folder under another number of buckets, as the same version."""
    rows, version = latest_snapshot(spark, folder)
    if rows is not None:
        merge_snapshot(rows, target, version, keys, lambda _, batch: batch, buckets)


def latest_snapshot(spark, folder: str) -> tuple[DataFrame | None, int]:
    """The newest complete version of a keyed table and its number (0 where there is none)."""
    versions = _manifests(spark, folder)
    if not versions:
        return None, 0
    manifest = read_manifest_of(spark, folder, versions[-1])
    return _read_buckets(spark, folder, manifest, sorted(manifest["live"])), versions[-1]
