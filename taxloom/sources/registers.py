"""CSV registers and ledgers with titles above the header.

Long form: ``rows(source_id, row_index, cells array<struct<name,value>>)`` and one ``meta`` row per
source (``source_id, source_order, filename, column_names, preamble``). Files may be small and many or
single and huge: lines are read as splittable text and numbered from per-split counts, so no file is
bound to one task.

A record may run over several lines inside quotes, and a split may begin inside one. So each line, and from its lines each split, is
read as a map from "begins inside quotes or not" to "ends inside quotes or not"; maps are put together by running windows, first
inside the splits, then over the few splits of a file, which gives every line its true state. Files in which no
line leaves a quote open skip all of this.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from taxloom import constants as C
from taxloom.functions.text import strip, vat_number_in
from taxloom.session import settle
from taxloom.sources.columns import with_ledger_columns, with_register_columns
from taxloom.sources.numbering import with_running_totals

# The inside of quotes (a doubled quote is a quote), a whole field, and what leaves a quote open at the end of a line.
_INSIDE = r'[^"]*+(?:""[^"]*+)*+'
_FIELD = rf'(?:"{_INSIDE}"[^,]*+|"{_INSIDE}\z|[^,"][^,]*+|)'
_OPEN = rf'(?:(?:"{_INSIDE}"[^,]*+|[^,"][^,]*+|),)*+"{_INSIDE}\z'


def csv_cells(record: Column) -> Column:
    """A record to its cells; texts that stand for a missing value become null. A quote inside an unquoted cell is an ordinary character."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit("," + _FIELD), F.lit(0))

    def value(field: Column) -> Column:
        body = F.substring(field, 2, F.length(field))
        inside = F.regexp_extract(body, rf'\A"({_INSIDE})"?', 1)
        after = F.regexp_extract(body, rf'(?s)\A"{_INSIDE}"(.*)', 1)
        text = F.when(body.startswith('"'), F.concat(F.replace(inside, F.lit('""'), F.lit('"')), after)).otherwise(body)
        return F.when(~text.isin(*C.CSV_MISSING), text)

    return F.transform(fields, value)


def _state_before(own: Column, swaps: Column, start: Column, order) -> Column:
    """Whether a line begins inside quotes. ``own``: 0 or 1 where the line ends so however it begins, else null; ``swaps``: 1 where it
    ends in the other state. The last fixed state before the line counts, turned as often as lines have swapped since."""
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turned = F.coalesce(F.sum(swaps).over(before), F.lit(0))
    upto = F.sum(swaps).over(order.rowsBetween(Window.unboundedPreceding, 0))
    fixed = F.last(F.when(own.isNotNull(), own + upto), ignorenulls=True).over(before)
    return F.pmod(F.coalesce(fixed, start) + turned, F.lit(2))


def join_records(lines: DataFrame) -> DataFrame:
    """(source_id, split, position, line): lines of one record joined by line feeds, at the place of the first.

    Where quotes are still open at the end of a file, the lines from that record on are records of their own.
    """
    opens = F.rlike("line", F.lit(r"\A" + _OPEN)).cast("int")
    stays = F.rlike("line", F.lit(rf"\A{_INSIDE}(?:\z|\"[^,]*+,{_OPEN})")).cast("int")
    # One row per source here and one per split below: stored, so that they are broadcast by their true size. Few keys fill too few
    # partitions for Spark to do so later on, and every line would be dealt by its source.
    quoted = settle(lines.filter(F.contains("line", F.lit('"'))).withColumn("e0", opens).filter("e0 = 1").select("source_id").distinct(), "quoted")
    broken = lines.join(quoted, "source_id", "left_semi").withColumns({"e0": opens, "e1": stays})
    broken = broken.withColumns({"own": F.when(F.col("e0") == F.col("e1"), F.col("e0")), "swap": ((F.col("e0") == 1) & (F.col("e1") == 0)).cast("int")})
    inside = Window.partitionBy("source_id", "split").orderBy("position")
    # one row per split: where it ends, and where its last record begins, if it begins outside quotes, and inside; no texts
    ends = broken.drop("line").withColumns({f"from_{s}": _state_before(F.col("own"), F.col("swap"), F.lit(s), inside) for s in (0, 1)})
    after = lambda s: F.max_by(F.when(F.col(s) == 1, F.col("e1")).otherwise(F.col("e0")), "position")
    latest = lambda s: F.max(F.when(F.col(s) == 0, F.col("position")))
    splits = ends.groupBy("source_id", "split").agg(after("from_0").alias("e0"), after("from_1").alias("e1"),
                                                    latest("from_0").alias("latest_0"), latest("from_1").alias("latest_1"))
    over = Window.partitionBy("source_id").orderBy("split")
    fixed = F.when(F.col("e0") == F.col("e1"), F.col("e0"))
    splits = splits.withColumn("begins", _state_before(fixed, ((F.col("e0") == 1) & (F.col("e1") == 0)).cast("int"), F.lit(0), over))
    inward = F.col("begins") == 1
    begins_at = F.when(inward, F.col("latest_1")).otherwise(F.col("latest_0"))
    # the first line of each record: in this split, or the last one that the splits before began
    first = splits.select("source_id", "split", "begins", F.when(inward, F.col("e1")).otherwise(F.col("e0")).alias("ends"),
                          F.when(begins_at.isNotNull(), F.struct("split", begins_at.alias("position"))).alias("latest"))
    carried = F.last("latest", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    whole = Window.partitionBy("source_id")
    unclosed = F.when(F.max_by("ends", "split").over(whole) == 1, F.max("latest").over(whole))
    known = settle(first.select("source_id", "split", "begins", carried.alias("carried"), unclosed.alias("unclosed")), "splits")
    states = broken.join(known, ["source_id", "split"]).withColumn("quoted", _state_before(F.col("own"), F.col("swap"), F.col("begins"), inside))
    place = F.struct("split", "position")
    begun = F.last(F.when(F.col("quoted") == 0, place), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    records = states.withColumn("begun", begun).select(
        "source_id", "line", place.alias("place"), F.when(F.coalesce(place >= F.col("unclosed"), F.lit(False)), place).otherwise(
            F.coalesce("begun", "carried")).alias("record"))
    joined = records.groupBy("source_id", "record").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("line"))
    plain = lines.join(quoted, "source_id", "left_anti").select("source_id", "split", "position", "line")
    return plain.unionByName(joined.select("source_id", "record.split", "record.position", "line"))


def _blank(value: Column) -> Column:
    return F.coalesce(strip(value) == "", F.lit(True))


def read_lines(spark: SparkSession, paths) -> DataFrame:
    """(source_id, split, position, line): ``position`` orders the lines of a split."""
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("source_id"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("position"), F.col("value").alias("line"))


def number_by_split(rows: DataFrame, name: str) -> DataFrame:
    """A gap-free number per source in file order: a running count inside each split, plus the counts of
    the splits before it. A split is bounded by ``spark.sql.files.maxPartitionBytes``."""
    counts = rows.groupBy("source_id", "split").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source_id").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settle(counts.select("source_id", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "offsets")
    inside = Window.partitionBy("source_id", "split").orderBy("position")
    return rows.withColumn("in_split", F.row_number().over(inside) - 1).join(offsets, ["source_id", "split"]).withColumn(
        name, F.col("in_split") + F.col("offset")).drop("in_split", "offset")


def read_registers(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """(rows, meta) of CSV files. Header: the first line with two filled cells, else the first line."""
    lines = join_records(read_lines(spark, paths)).filter(~_blank(F.col("line")))
    # Stored, as they are read for the header, the titles, the numbers and the rows; of headers there is one per source.
    cells = settle(lines.select("source_id", "split", "position", csv_cells(F.col("line")).alias("values")), "cells")
    filled = F.size(F.filter("values", lambda v: ~_blank(v)))
    place = F.struct("split", "position")
    header_at = settle(cells.groupBy("source_id").agg(
        F.coalesce(F.min(F.when(filled >= 2, place)), F.min(place)).alias("header_at")), "header_at")
    marked = cells.join(header_at, "source_id")
    headers = settle(marked.filter(place == F.col("header_at")).select(
        "source_id", F.transform("values", lambda v, i: F.when(_blank(v), F.concat(F.lit("Unnamed: "), i.cast("string")))
                                 .otherwise(strip(v))).alias("column_names")), "headers")
    above = marked.filter((place < F.col("header_at")) & (filled > 0)).groupBy("source_id").agg(F.array_sort(F.collect_list(
        F.struct("split", "position", F.array_join(F.transform(
            F.filter("values", lambda v: ~_blank(v)), strip), " ").alias("text")))).alias("lines"))
    meta = with_running_totals(headers.join(above, "source_id", "left"), ["source_id"], before=F.lit(1)).select(
        "source_id", (F.col("before") + 1).cast("int").alias("source_order"),
        F.regexp_extract("source_id", r"[^/]*$", 0).alias("filename"), "column_names",
        F.coalesce(F.transform("lines", lambda x: x["text"]), F.array().cast("array<string>")).alias("preamble"))
    data = marked.filter((place > F.col("header_at")) & (F.size(F.filter("values", lambda v: v.isNotNull())) > 0))
    rows = number_by_split(data.select("source_id", "split", "position", "values"), "row_index").join(
        headers, "source_id").select(
        "source_id", "row_index",
        # cells beyond the header's width are kept, under the names that blank headers get
        F.transform(F.sequence(F.lit(0), F.greatest(F.size("column_names"), F.size("values"), F.lit(1)) - 1), lambda i: F.struct(
            F.coalesce(F.get("column_names", i), F.concat(F.lit("Unnamed: "), i.cast("string"))).alias("name"),
            F.get("values", i).alias("value"))).alias("cells"))
    return rows, meta


def guessed_role(has_reclaimable: Column, filename: Column, preamble: Column) -> Column:
    text = F.lower(F.concat_ws(" ", filename, F.array_join(preamble, " ")))
    any_of = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))
    return (F.when(has_reclaimable | any_of(C.PURCHASE_KEYWORDS), "purchases")
            .when(any_of(C.SALES_KEYWORDS), "sales").otherwise("unknown"))


def describe_sources(meta: DataFrame) -> DataFrame:
    """Meta with resolved register columns, a guessed role, a business name and a VAT number if printed."""
    named = with_register_columns(meta)
    first = strip(F.get("preamble", 0))
    # Up to the first spaced dash of any kind.
    name = F.nullif(strip(F.regexp_extract(first, r"(?Us)^(.*?)\s[—–-]\s", 1)), F.lit(""))
    return named.withColumns({
        "guessed_role": guessed_role(F.col("columns.reclaimable").isNotNull(), F.col("filename"), F.col("preamble")),
        "business_name": name,
        "vat_number": F.get(F.filter(F.transform("preamble", vat_number_in), lambda v: v.isNotNull()), 0),
    })


def business_name(described: DataFrame) -> DataFrame:
    """The name offered for the report: that of the first source that states one."""
    return described.filter(F.col("business_name").isNotNull()).agg(
        F.min_by("business_name", "source_order").alias("business_name"))


def usable_ledger_tables(meta: DataFrame) -> DataFrame:
    """Tables with an amount, debit or credit column, with their resolved columns."""
    named = with_ledger_columns(meta)
    return named.filter(F.coalesce("columns.amount", "columns.debit", "columns.credit").isNotNull())
