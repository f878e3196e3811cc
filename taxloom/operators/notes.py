"""Notes, activity, customer memories and stored batches: newest-first reads and keyed merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def named(customer: str) -> Column:
    """Case-insensitive containment; % and _ in the name act as wildcards."""
    return F.col("customer_name").ilike(f"%{customer}%")


def latest_note(notes: DataFrame, user_id: str) -> DataFrame:
    return notes.filter(F.col("user_id") == user_id).orderBy(F.desc("created_at")).limit(1)


def latest_notes(notes: DataFrame) -> DataFrame:
    """The newest note of every user."""
    whole = F.struct(*[F.col(c) for c in notes.columns if c != "user_id"])
    return notes.groupBy("user_id").agg(F.max_by(whole, "created_at").alias("note")).select("user_id", "note.*")


def customer_notes(notes: DataFrame, user_id: str, customer: str, limit: int = 10) -> DataFrame:
    return notes.filter((F.col("user_id") == user_id) & named(customer)).orderBy(F.desc("created_at")).limit(limit)


def newest_per_user(rows: DataFrame, limit: int, order: str = "created_at", tie: str | None = None) -> DataFrame:
    """The newest rows of every user, e.g. recent activity."""
    keys = [F.desc(order)] + ([F.desc(tie)] if tie else [])
    w = Window.partitionBy("user_id").orderBy(*keys)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def recent_activity(activity: DataFrame, user_id: str, limit: int = 5) -> DataFrame:
    return activity.filter(F.col("user_id") == user_id).orderBy(F.desc("created_at")).limit(limit)


def customer_memories(memories: DataFrame, user_id: str, customer: str | None = None, limit: int = 10) -> DataFrame:
    mine = memories.filter(F.col("user_id") == user_id)
    return (mine.filter(named(customer)) if customer else mine).orderBy(F.desc("created_at")).limit(limit)


def upsert_memories(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """Merges updates ``user_id, customer_name, customer_context, issue_summary, seq, ts`` into stored rows
    ``user_id, customer_name, customer_context, issue_summary, created_at, updated_at``.

    Context is appended line by line in update order, the issue is overwritten, updated_at moves on.
    """
    key = ["user_id", "customer_name"]
    fresh = updates.groupBy(*key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "customer_context"))),
                                 lambda x: x["customer_context"]), "\n").alias("new_context"),
        F.max_by("issue_summary", "seq").alias("new_issue"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    both = stored.join(fresh, key, "full_outer")
    touched = F.col("last_ts").isNotNull()
    known = F.col("created_at").isNotNull()
    text = F.when(~touched, F.col("customer_context")).when(
        known, F.concat(F.coalesce("customer_context", F.lit("")), F.lit("\n"), F.col("new_context"))).otherwise(F.col("new_context"))
    return both.select(
        *key, text.alias("customer_context"),
        F.when(touched, F.col("new_issue")).otherwise(F.col("issue_summary")).alias("issue_summary"),
        F.coalesce("created_at", "first_ts").alias("created_at"), F.coalesce("last_ts", "updated_at").alias("updated_at"))


def visible_batches(batches: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """Batches asked for by ``requests(batch_id, user_id[, kind])`` that exist, belong to the asker, have not
    expired and are of the kind asked for. What is unknown, foreign or expired is simply absent."""
    keys = [c for c in ("batch_id", "user_id", "kind") if c in requests.columns]
    live = batches.filter(F.col("expires_at") > as_of)
    return live.join(requests.select(*keys).distinct(), keys, "left_semi")


def ready_batches(batches: DataFrame) -> DataFrame:
    return batches.filter(F.col("status") == "ready")


def note_lines(notes: DataFrame) -> DataFrame:
    """Notes as answer lines."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return notes.withColumn("line", F.concat(
        F.lit("* "), said("customer_name"), F.lit(" | "), said("status"), F.lit(" | "), said("notes"), F.lit(" | "), said("created_at")))


def _grams(text: Column, size: int) -> Column:
    """The distinct pieces of ``size`` characters; none of a shorter text."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(size))))).otherwise(
        F.array().cast("array<string>"))


def _question_grams(wanted: Column) -> Column:
    """Pieces that every name fitting the pattern must hold: of three characters, where the pattern has none of two, else of one, else
    the empty piece, which every name holds. Wildcards and escapes end a run of literal characters."""
    runs = F.split(wanted, r"[%_\\]")
    of = lambda size: F.array_distinct(F.flatten(F.transform(runs, lambda r: _grams(r, size))))
    three, two, one = of(3), of(2), of(1)
    return F.when(F.size(three) > 0, three).when(F.size(two) > 0, two).when(F.size(one) > 0, one).otherwise(F.array(F.lit("")))


def names_asked_for(asked: DataFrame, names: DataFrame) -> DataFrame:
    """``asked(user_id, wanted)`` with every one of the user's ``names(user_id, noted)`` that holds it, case aside (% and _ are wildcards).

    Names are listed under their pieces of up to three characters. A question looks only at the list of its rarest piece, and
    asks ``ilike`` of those names; a question one of whose pieces is in no name of the user has no answer. Both sides are distinct.
    """
    low = F.lower("noted")
    pieces = F.concat(F.array(F.lit("")), *[_grams(low, n) for n in (1, 2, 3)])
    listed = names.select("user_id", "noted", F.explode(pieces).alias("piece"))
    counts = listed.groupBy("user_id", "piece").agg(F.count(F.lit(1)).alias("names"))
    sought = asked.select("user_id", "wanted", F.explode(_question_grams(F.lower("wanted"))).alias("piece"))
    rarest = sought.join(counts, ["user_id", "piece"], "left").groupBy("user_id", "wanted").agg(
        F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "piece")).alias("best")).filter("best.names > 0").select(
        "user_id", "wanted", F.col("best.piece").alias("piece"))
    return rarest.join(listed, ["user_id", "piece"]).filter(F.expr("noted ilike concat('%', wanted, '%')")).select("user_id", "wanted", "noted")


def note_answers(requests: DataFrame, notes: DataFrame, limit: int = 10) -> DataFrame:
    """Per request ``request_id, user_id, customer_name`` the newest matching notes as one text, or an
    explicit "none". Without a customer the newest note of the user is used."""
    lines = note_lines(notes).select("user_id", F.col("customer_name").alias("noted"), "created_at", "line")
    order = [F.desc("created_at"), "line"]
    # At most ``limit`` notes per user and name can matter, and equal questions are answered once.
    per_name = Window.partitionBy("user_id", "noted").orderBy(*order)
    heads = lines.withColumn("r", F.row_number().over(per_name)).filter(F.col("r") <= limit).drop("r")
    asked = requests.select("user_id", F.lower("customer_name").alias("wanted")).distinct()
    per_ask = Window.partitionBy("user_id", "wanted").orderBy(*order)
    newest = lines.groupBy("user_id").agg(F.max_by("line", F.struct("created_at", "line")).alias("line"))
    by_user = asked.filter("wanted is null").join(newest, "user_id").select("user_id", "wanted", F.lit(1).alias("rank"), "line")
    fitting = names_asked_for(asked.filter("wanted is not null"), lines.filter("noted is not null").select("user_id", "noted").distinct())
    by_name = fitting.join(heads, ["user_id", "noted"]).withColumn("rank", F.row_number().over(per_ask)).filter(
        F.col("rank") <= limit).select("user_id", "wanted", "rank", "line")
    hits = by_user.unionByName(by_name)
    top = requests.withColumn("wanted", F.lower("customer_name")).alias("q").join(
        hits.alias("h"), (F.col("q.user_id") == F.col("h.user_id")) & F.col("q.wanted").eqNullSafe(F.col("h.wanted")))
    text = top.groupBy("request_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("found"))
    none = F.concat(F.lit("No filing records"), F.coalesce(F.concat(F.lit(" for "), F.col("customer_name")), F.lit("")), F.lit("."))
    return requests.join(text, "request_id", "left").select("request_id", F.coalesce("found", none).alias("answer"))
