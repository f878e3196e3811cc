"""Each streaming job against the batch result on the same input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from taxloom.operators import invoices, sessions
from taxloom.plans import lens
from taxloom.plans.ingest import prose_points
from taxloom.sources import stores
from taxloom.streaming import jobs


def as_stream(spark, df, folder, files=3):
    df.repartition(files).write.parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


@pytest.fixture()
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def messages(spark, sf):
    c = lens.table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


def test_bounded_history(spark, sf, tmp_path, rocksdb):
    data = messages(spark, sf)
    latest = {}
    query = jobs.bounded_history(as_stream(spark, data, tmp_path / "in"), 3).writeStream.outputMode("update").foreachBatch(
        lambda df, _: latest.update({k: g for k, g in df.toPandas().groupby("thread_id")})).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((t, s) for t, g in latest.items() for s in g["seq"])
    want = sorted((r.thread_id, r.seq) for r in sessions.newest(data, 3).select("thread_id", "seq").collect())
    assert got == want


def test_memory_and_profile_streams(spark, tmp_path):
    schema = "user_id string, customer_name string, customer_context string, issue_summary string, seq bigint, ts timestamp"
    for n, text in enumerate(["first", "second", "third"]):
        spark.createDataFrame([("u", "Acme", text, f"issue {n}", n, dt.datetime(2024, 1, 1 + n))], schema).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "mem"))
        q = jobs.memory_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "mem")), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
    row = stores.latest_snapshot(spark, str(tmp_path / "out"))[0].first()
    assert (row.customer_context, row.issue_summary) == ("first\nsecond\nthird", "issue 2")
    assert row.created_at < row.updated_at

    schema = ("user_id string, seq bigint, user_name string, email string, preferred_language string, "
              "preferred_tone string, last_activity_summary string")
    for n, name in enumerate(["Sam", None]):
        spark.createDataFrame([("u", n, name, None if n == 0 else "s@x", None, None, None)], schema).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "prof"))
        jobs.profile_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "prof")), str(tmp_path / "pout"),
                            str(tmp_path / "pcp")).awaitTermination()
    row = stores.latest_snapshot(spark, str(tmp_path / "pout"))[0].first()
    assert (row.user_name, row.email) == ("Sam", "s@x")


def test_expiry(spark, tmp_path, rocksdb):
    t0 = dt.datetime(2024, 1, 1)
    schema = "batch_id string, user_id string, created_at timestamp, expires_at timestamp"
    out = []
    for n, hours in enumerate([0, 30, 60]):
        at = t0 + dt.timedelta(hours=hours)
        spark.createDataFrame([(f"b{n}", "u", at, at + dt.timedelta(hours=24))], schema).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.expired_batches(stream).writeStream.outputMode("append").foreachBatch(
            lambda df, _: out.extend(r.batch_id for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(
            availableNow=True).start().awaitTermination()
    assert sorted(out) == ["b0", "b1"]


def test_invoice_stream_equals_batch(spark, sf, tmp_path):
    data = lens.invoices(spark, sf)
    stream = as_stream(spark, data, tmp_path / "in")
    jobs.invoice_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "1999-06-01").awaitTermination()
    key = lambda df: sorted((r.filename, r.status) for r in df.select("filename", "status").collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(invoices.check_invoices(data, "1999-06-01"))


def test_ingest_stream_is_idempotent(spark, tmp_path):
    schema = ("path string, document_type string, version_label string, language string, is_current boolean, "
              "source_site string, source_url string, text string")
    doc = lambda text: spark.createDataFrame([("p", "Reg", "current", "en", True, None, None, text)], schema)
    first = "# Article 1\none\n# Article 2\ntwo"
    for text in (first, first, "# Article 1\nchanged"):
        doc(text).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.ingest_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"),
                           str(tmp_path / "cp")).awaitTermination()
    got = {r.article_number: r.text for r in stores.latest_snapshot(spark, str(tmp_path / "out"))[0].collect()}
    assert got == {"1": "Reg, Article 1: changed", "2": "Reg, Article 2: two"}
    assert prose_points(doc(first)).count() == 2


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    """Merged versions equal one merge of everything; a small batch writes few buckets; a replay and a lost manifest change nothing."""
    folder = str(tmp_path / "t")
    rows = lambda low, high, v: spark.range(low, high).select("id", F.lit(v).alias("v"))

    def merge(old, batch):
        both = batch if old is None else old.join(batch, "id", "left_anti").unionByName(batch)
        return both.select("id", "v")

    files = lambda: {str(p.relative_to(folder)) for p in (tmp_path / "t" / "data").rglob("*.parquet")}
    assert stores.merge_snapshot(rows(0, 1000, "a"), folder, 1, ["id"], merge, 16)
    before = files()
    assert stores.merge_snapshot(rows(3, 5, "b"), folder, 2, ["id"], merge)
    assert 1 <= len({f.split("/")[1] for f in files() - before}) <= 2
    assert before <= files()  # the version before is still whole
    assert not stores.merge_snapshot(rows(0, 1000, "x"), folder, 2, ["id"], merge)  # replayed
    assert stores.merge_snapshot(rows(0, 0, "x"), folder, 3, ["id"], merge)  # an empty batch
    (tmp_path / "t" / "data" / "v=000000000004" / "bucket=0").mkdir(parents=True)  # a version that failed half-way
    assert stores.merge_snapshot(rows(999, 1002, "c"), folder, 4, ["id"], merge)
    got, version = stores.latest_snapshot(spark, folder)
    want = {i: "b" if i in (3, 4) else "c" if i >= 999 else "a" for i in range(1002)}
    assert version == 4 and dict(got.collect()) == want and got.count() == len(want)
    assert stores._manifests(spark, folder) == [3, 4]
    stores.rebucket(spark, folder, str(tmp_path / "u"), ["id"], 3)
    assert dict(stores.latest_snapshot(spark, str(tmp_path / "u"))[0].collect()) == want
    assert stores.read_manifest_of(spark, str(tmp_path / "u"), 4)["buckets"] == 3


def test_null_keys_and_an_empty_first_batch(spark, tmp_path):
    merge = lambda old, batch: batch if old is None else old.unionByName(batch)
    folder, schema = str(tmp_path / "t"), "k string, v int"
    assert stores.latest_snapshot(spark, folder) == (None, 0)
    stores.merge_snapshot(spark.createDataFrame([], schema), folder, 1, ["k"], merge)
    assert stores.latest_snapshot(spark, folder)[0].collect() == []
    stores.merge_snapshot(spark.createDataFrame([(None, 1), ("x", 2)], schema), folder, 2, ["k"], merge)
    stores.merge_snapshot(spark.createDataFrame([(None, 3)], schema), folder, 3, ["k"], merge)
    assert sorted(r.v for r in stores.latest_snapshot(spark, folder)[0].collect()) == [1, 2, 3]
