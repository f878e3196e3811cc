"""Every operator as a query over the whole test tables: name to ``(spark, sf_dir) -> DataFrame``.

Money leaves as double and dates as text, so that other engines' results can be compared by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from taxloom.functions import ids, money, refs, text
from taxloom.operators import (chunks, groups, html, invoices, match, notes, period, retrieve, review, sessions, structure,
                               summary, tables, vat)
from taxloom.plans import ingest as ingest_plan, lens, reconcile as rec, reports
from taxloom.session import stored_path
from taxloom.sources import files, ledgers, payloads, registers, stores
from taxloom.streaming import jobs

AS_OF = "1999-06-01"


def dbl(name: str, alias: str | None = None):
    return F.col(name).cast("double").alias(alias or name.split(".")[-1])


# --- VAT and invoices -----------------------------------------------------------------------------------


def invoice_totals(s: SparkSession, sf: str) -> DataFrame:
    t = vat.invoice_totals(lens.lines(s, sf))
    return t.select("invoice_id", dbl("subtotal"), dbl("total_vat"), dbl("grand_total"), "has_flagged_lines", "line_count")


def line_vat(s, sf):
    lines = vat.calculate_lines(lens.lines(s, sf))
    return lines.groupBy("tax_category").agg(
        F.count(F.lit(1)).alias("line_count"), F.sum("vat_amount").cast("double").alias("vat"),
        F.count_if("flagged_for_manual_review").alias("flagged"))


def totals_mismatch(s, sf):
    totals = vat.invoice_totals(lens.lines(s, sf))
    out = vat.validate_totals(totals, lens.printed_totals(totals))
    return out.select("invoice_id", "field", dbl("document_value"), dbl("recalculated_value"), "within_tolerance")


def _checked(s, sf):
    return invoices.check_invoices(lens.invoices(s, sf), AS_OF, lens.suggestions(s, sf))


def invoice_status(s, sf):
    count = lambda pred: F.size(F.filter("structural_issues", pred)).alias
    return _checked(s, sf).select(
        "filename", "status", count(lambda i: i["severity"] == "error")("errors"),
        count(lambda i: i["severity"] == "warning")("warnings"), F.size("mismatches").alias("mismatches"),
        F.size(F.filter("mismatches", lambda m: ~m["within_tolerance"])).alias("significant"), dbl("total_vat"))


def batch_counts(s, sf):
    return invoices.batch_counts(_checked(s, sf))


def structural_issues(s, sf):
    d = structure.validate_documents(lens.documents(s, sf), AS_OF)
    return d.select("document_id", F.posexplode("issues").alias("position", "i")).select(
        "document_id", "position", F.col("i.rule_id").alias("rule_id"), F.col("i.field").alias("field"),
        F.col("i.severity").alias("severity"))


def category_resolution(s, sf):
    r = invoices.category_resolution(lens.invoices(s, sf), lens.suggestions(s, sf))
    return r.groupBy("filename", "tax_category").agg(
        F.count(F.lit(1)).alias("line_count"), F.sum("taxable_base").cast("double").alias("base"))


def invoice_reasons(s, sf):
    return invoices.invoice_summary(_checked(s, sf)).select("filename", "status", "seller_vat_number", "buyer_name", "reason")


def issue_detail(s, sf):
    return invoices.issue_detail(_checked(s, sf)).select("filename", "part", "pos", "severity", "what", "text")


def classification_split(s, sf):
    li = lens.table(s, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("line_id"),
        F.when(F.col("l_returnflag") == "A", "standard").when(F.col("l_returnflag") == "N", "other")
        .otherwise(F.lit(None)).alias("tax_category"), F.col("l_discount").alias("confidence"))
    good, bad = vat.split_classifications(li)
    return good.select("line_id", "tax_category", F.lit("valid").alias("outcome")).unionByName(
        bad.select("line_id", "tax_category", F.lit("invalid").alias("outcome")))


def payload_lines(s, sf):
    """Invoice lines through JSON and back: parsed, or rejected by the first bad line."""
    bad = F.when(F.col("invoice_id") % 40 == 3, "n/a").otherwise(F.col("taxable_base").cast("string"))
    lines = lens.lines(s, sf).withColumns({
        "taxable_base": bad, "tax_category": F.when(F.col("invoice_id") % 50 == 7, "luxury").otherwise(F.col("tax_category"))})
    packed = lines.groupBy("invoice_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(
        "line_id", "description", "taxable_base", "tax_category", "flag")))).alias("payload"))
    good, rejected = payloads.parse_lines(packed)
    return vat.invoice_totals(good).select("invoice_id", dbl("total_vat"), F.lit("parsed").alias("outcome")).unionByName(
        rejected.select("invoice_id", F.lit(None).cast("double").alias("total_vat"), F.lit("rejected").alias("outcome")))


def result_roundtrip(s, sf):
    lines = vat.calculate_lines(lens.lines(s, sf))
    back = payloads.results_from_json(payloads.results_to_json(lines, vat.invoice_totals(lens.lines(s, sf))))
    return back.select("invoice_id", F.size("lines").alias("line_count"), dbl("total_vat"), dbl("grand_total"), "has_flagged_lines")


# --- reconciliation ------------------------------------------------------------------------------------------


def _sides(s, sf):
    return lens.ledger(s, sf), lens.statement(s, sf)


def match_reference(s, sf):
    return match.match_reference(*_sides(s, sf)).select(
        F.col("row_a.row_id").alias("row_a"), F.col("row_b.row_id").alias("row_b"), "agrees", "possible_vat_gap")


def vat_gap(s, sf):
    p = match.match_reference(*_sides(s, sf)).filter(~F.col("agrees"))
    return p.groupBy("possible_vat_gap").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs(F.col("row_a.amount") - F.col("row_b.amount"))).cast("double").alias("gap"))


def _after_reference(s, sf):
    a, b = _sides(s, sf)
    pairs = match.match_reference(a, b)
    return match.leftovers(a, pairs, "a"), match.leftovers(b, pairs, "b")


def match_amount(s, sf):
    return match.match_amount(*_after_reference(s, sf)).select(
        F.col("row_a.row_id").alias("row_a"), F.col("row_b.row_id").alias("row_b"), dbl("row_a.amount", "amount"))


def fuzzy_candidates(s, sf):
    a, b = _after_reference(s, sf)
    pairs = match.match_amount(a, b)
    found = match.fuzzy_candidates(match.leftovers(a, pairs, "a"), match.leftovers(b, pairs, "b"))
    return found.select("row_id", F.col("n_candidates").cast("bigint"), F.col("n_wanting").cast("bigint"))


def fuzzy_classification(s, sf):
    r = rec.simple_passes(*_sides(s, sf))
    return r.items.select("item_id", "kind", "n_candidates", F.col("row_a.row_id").alias("row_a"), F.col("row_b.row_id").alias("row_b"))


def unmatched_rows(s, sf):
    a, b = rec.unmatched_pools(rec.simple_passes(*_sides(s, sf)).items)
    return a.unionByName(b).select("row_id", "source", dbl("amount"))


def _reviewed(s, sf):
    r = rec.simple_passes(*_sides(s, sf))
    return r.matched, review.apply_decisions(r.items, lens.decisions(r.items, r.candidates)), r.candidates


def leftover_pool(s, sf):
    a, b = review.leftover_pool(*_reviewed(s, sf))
    return a.unionByName(b).select("row_id", "source", dbl("amount"))


def stale_items(s, sf):
    matched, items, _ = _reviewed(s, sf)
    return review.drop_stale_unmatched(matched, items).select("item_id", "kind", "decision")


def double_claims(s, sf):
    _, items, _ = _reviewed(s, sf)
    return review.double_claims(items).select("candidate_id", "item_id", "n_claims")


def invalid_selections(s, sf):
    _, items, candidates = _reviewed(s, sf)
    wrong = items.withColumn("selected_candidate_id", F.when(F.col("row_a.ordinal") % 2 == 0, F.lit("b_none")).otherwise(
        F.col("selected_candidate_id")))
    return review.invalid_selections(wrong, candidates)


def contested_groups(s, sf):
    r = rec.simple_passes(*_sides(s, sf))
    return review.contested_groups(r.items, r.candidates).select("candidate_id", "item_id", "n_items")


def group_decisions(s, sf):
    """Contested groups decided by candidate: one item picked, none, or unsure."""
    r = rec.simple_passes(*_sides(s, sf))
    g = review.contested_groups(r.items, r.candidates)
    k = F.split("candidate_id", "_")[1].cast("bigint")
    picks = g.groupBy("candidate_id").agg(F.min("item_id").alias("first")).select(
        "candidate_id", F.when(k % 3 == 0, F.col("first")).alias("picked_item_id"), (k % 3 == 1).alias("unsure"),
        F.lit("seen").alias("explanation"))
    out = review.apply_group_decisions(r.items, r.candidates, picks)
    return out.filter("explanation is not null").select("item_id", "decision", "selected_candidate_id")


def control_totals(s, sf):
    r = rec.simple_passes(*_sides(s, sf))
    t = summary.control_totals(r.matched, r.items, r.candidates)
    return t.select(*[dbl(c) for c in ("matched_amount_a", "matched_amount_b", "grand_total_a", "grand_total_b")], "matched_count")


def summary_counts(s, sf):
    _, items, _ = _reviewed(s, sf)
    return summary.item_counts(items)


def exception_rows(s, sf):
    _, items, candidates = _reviewed(s, sf)
    return summary.exception_rows(items, candidates)


def exception_findings(s, sf):
    _, items, candidates = _reviewed(s, sf)
    return summary.exception_findings(items, candidates)


def sequential_references(s, sf):
    o = lens.table(s, sf, "orders")
    series = F.concat(F.lit("PO"), F.col("o_orderstatus"), F.lit("-"))
    rows = o.select(F.col("o_orderkey").alias("ordinal"), F.concat(series, (F.col("o_orderkey") * 7).cast("string")).alias("reference"))
    return groups.rows_with_sequential_sibling(rows).select("ordinal", "reference")


def _pools(s, sf):
    return rec.unmatched_pools(rec.simple_passes(*_sides(s, sf)).items)


def group_options(s, sf):
    """For every unmatched ledger row, whether none, one or more small groups of statement rows fit."""
    a, b = _pools(s, sf)
    return groups.group_options(a, b).select(
        F.col("t_ord").alias("target"), "n", F.array_join(F.transform("only", lambda x: x.cast("string")), ",").alias("members"))


def group_matches(s, sf):
    items = groups.group_matches(*_pools(s, sf))
    return items.select("item_id", "kind", F.array_join(F.transform("group", lambda g: g["row_id"]), ",").alias("members"))


def leftover_sums(s, sf):
    """Pass 5 after a review that accepted every proposal of passes 1 to 4."""
    r = rec.reconcile(*_sides(s, sf))
    items = review.apply_decisions(r.items, lens.accept_all(r.items, r.candidates))
    found = rec.reconcile_leftovers(r.matched, items, r.candidates)
    return found.select("item_id", "kind", F.array_join(F.transform("group", lambda g: g["row_id"]), ",").alias("members"))


def reconcile_counts(s, sf):
    r = rec.reconcile(*_sides(s, sf))
    return r.items.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def register_scan(s, sf):
    """Orders written as CSV registers with line breaks, quotes and commas inside quotes, and read back record by record."""
    o = lens.table(s, sf, "orders")
    k = F.col("o_orderkey")
    note = F.when(k % 3 == 0, F.concat(F.lit("lot "), k.cast("string"))).when(k % 3 == 1, F.concat(
        F.lit("line one, of "), k.cast("string"), F.lit('\n"second"\n\nlast'))).otherwise(F.concat(F.lit('say "'), k.cast("string"), F.lit('"\n')))
    path = stored_path(s, "registers")
    o.select(F.concat(F.lit("D-"), k.cast("string")).alias("Doc No"), note.alias("Note"), lens.cents("o_totalprice").cast("string").alias("Amount")).write.csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows, _ = registers.read_registers(s, path)
    cell = lambda name: F.get(F.filter("cells", lambda c: c["name"] == name), 0)["value"]
    return rows.select(cell("Doc No").alias("doc_no"), F.size("cells").alias("n_cells"), F.md5(cell("Note").cast("binary")).alias("note_md5"), cell("Amount").alias("amount"))


def ledger_rows(s, sf):
    """Ledger rows from table cells with debit and credit columns and mixed date forms."""
    o = lens.table(s, sf, "orders")
    k = F.col("o_orderkey")
    day = F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 3 == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(
        F.date_format("o_orderdate", "d MMM yyyy"))
    head = ["Doc No.", "Posting Date", "Debit", "Credit", "Narration"]
    total = lens.cents("o_totalprice").cast("string")
    cells = lens._cells(head, [
        F.concat(F.lit(" D-"), k.cast("string"), F.lit(" ")), day, F.when(k % 2 == 0, F.concat(F.lit("SAR "), total)).otherwise(F.lit("0.00")),
        F.when(k % 2 == 1, F.concat(F.lit("-"), total)).when(k % 10 == 0, F.lit("n/a")), F.when(k % 5 != 0, F.col("o_orderpriority"))])
    rows = o.select(F.lit("gl").alias("source_id"), k.alias("row_index"), cells.alias("cells"))
    meta = s.createDataFrame([("gl", head)], "source_id string, column_names array<string>")
    out = ledgers.rows_from_tables(rows, meta, "a")
    return out.select("row_id", "reference", F.date_format("date", "yyyy-MM-dd").alias("date"), dbl("amount"), "description")


def normalized_references(s, sf):
    d = lens.table(s, sf, "customer").unionByName(lens.table(s, sf, "supplier").select(
        F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey"),
        F.col("s_acctbal").alias("c_acctbal"), F.lit("x").alias("c_mktsegment")))
    ref = F.concat(F.lit(" "), F.upper("c_name"), F.lit("/"), F.col("c_nationkey").cast("string"))
    return d.select(ref.alias("raw"), refs.normalized_reference(ref).alias("reference"))


def description_tokens(s, sf):
    p = lens.table(s, sf, "part")
    t = F.concat_ws(" ", F.lit("Purchase of"), "p_name", "p_type", "p_brand")
    return p.select("p_partkey", F.array_join(refs.description_tokens(t), " ").alias("tokens"))


# --- period return -----------------------------------------------------------------------------------------------


def _period(s, sf):
    meta = registers.describe_sources(lens.register_meta(s))
    return period.period_return(lens.register_rows(s, sf), meta, None, lens.default_rates(s))


def register_rows(s, sf):
    meta = registers.describe_sources(lens.register_meta(s))
    lines = period.register_lines(lens.register_rows(s, sf), period.select_sources(meta))
    return lines.groupBy("source_id", "role", "is_total").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("amount"), F.sum("vat_amount").cast("double").alias("vat"))


def total_check(s, sf):
    issues = _period(s, sf).issues
    return issues.filter(F.col("issue").isin("total_differs", "reclaimable_total_differs", "default_rate_assumed")).select(
        "source_id", "issue", "detail")


def row_vat_check(s, sf):
    lines = _period(s, sf).lines.filter("vat_mismatch")
    return lines.select("source_id", "row_index", "label", dbl("vat_amount"),
                        F.array_join(F.transform("expected", lambda e: e.cast("string")), " or ").alias("expected"))


def reclaimability(s, sf):
    p = _period(s, sf).purchases
    return p.select("source_id", "row_index", dbl("vat_amount"), "reclaimable", "reason_code", "keyword", "needs_review")


def _headline(h):
    return h.select(dbl("output_vat"), dbl("input_vat_total"), dbl("reclaimable_input_vat"), dbl("net_position"),
                    "sales_row_count", "purchase_row_count", "pending_count", "status")


def period_headline(s, sf):
    return _headline(_period(s, sf).headline)


def _decided(s, sf, made=None):
    p = _period(s, sf) if made is None else made
    decisions = p.review_items.filter(F.col("row_index") % 2 == 0).select(
        "item_id", (F.col("row_index") % 4 == 0).alias("reclaimable")).distinct()
    return period.apply_decisions(p.lines, decisions)


def period_final(s, sf):
    return _headline(_decided(s, sf).headline)


def excluded_purchases(s, sf):
    return period.excluded_purchases(_decided(s, sf).lines).select("source_id", "row_index", dbl("vat_amount"), "reason_code")


def headline_rows(s, sf):
    return period.headline_rows(_period(s, sf).headline).select("position", "key", dbl("value"), "label")


# --- knowledge base ------------------------------------------------------------------------------------------------


def _hits(s, sf):
    return retrieve.vector_topk(lens.vector_queries(s, sf), lens.points(s, sf))


def vector_topk(s, sf):
    return _hits(s, sf).select("query_id", "scope", "id", "rank", F.round("score", 6).alias("score"))


def language_fallback(s, sf):
    hits = retrieve.with_language_fallback(retrieve.relevant(_hits(s, sf)))
    return hits.select("query_id", "id", "rank", "cross_language")


def _context(s, sf, told=True):
    return retrieve.retrieve(lens.vector_queries(s, sf), lens.points(s, sf), tables.table_texts(lens.nation_tables(s, sf)), told=told)


def retrieve_context(s, sf):
    return _context(s, sf).select("query_id", "position", "tier", "content_kind", "table_ref", "cross_language",
                                  F.md5("text").alias("text_md5"))


def cross_reference(s, sf):
    """References of every prose point, resolved one hop."""
    points = lens.points(s, sf)
    hits = points.select(F.col("id").alias("query_id"), "id", F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    parts = retrieve.context_parts(hits, points, tables.table_texts(lens.nation_tables(s, sf)))
    return parts.filter(F.col("tier") == 2).select("query_id", "step", "content_kind", "document_type", "table_ref", "source_url")


def reply_kinds(s, sf):
    q = lens.vector_queries(s, sf).withColumn("text", F.when(F.col("query_id").endswith("3"), F.concat(
        F.lit("What about Oman? "), "text")).otherwise(F.col("text")))
    return retrieve.reply_kinds(q.select("query_id", "text"), _context(s, sf))


def context_block(s, sf):
    block = retrieve.context_block(_context(s, sf, told=False), tables.table_texts(lens.nation_tables(s, sf)))
    return block.select("query_id", F.md5("context").alias("context_md5"))


def chunk_articles(s, sf):
    c = chunks.chunk_documents(lens.articles(s, sf))
    return c.select("doc_id", "article_number", "part_index", "word_count", F.md5("text").alias("text_md5"))


def chunk_references(s, sf):
    c = chunks.chunk_documents(lens.articles(s, sf))
    return c.select("doc_id", "article_number", "part_index",
                    F.array_join(F.transform("references", lambda r: r["article_number"]), ",").alias("cited"))


def chunk_fallback(s, sf):
    """The documents as they are have no articles: sections by paragraph, cut at the word limit."""
    d = lens.table(s, sf, "documents").select("doc_id", F.col("source").alias("document_type"), F.lit("en").alias("language"), "text")
    return chunks.chunk_documents(d).select("doc_id", "article_number", "part_index", "word_count", F.md5("text").alias("text_md5"))


def _regulations(s, sf):
    return lens.articles(s, sf).select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").cast("string").alias("document_type"),
        F.lit("current").alias("version_label"), "language", F.lit(True).alias("is_current"), F.lit("site").alias("source_site"),
        F.lit("url").alias("source_url"), "text")


def ingest_points(s, sf):
    """Documents and nation tables to points, with counts per source."""
    docs = _regulations(s, sf)
    meta = lens.table_meta(s, sf).select(
        "table_ref", "document_type", "column_names", "language", F.col("table_ref").alias("path"),
        F.lit("current").alias("version_label"), F.lit(True).alias("is_current"), F.lit("site").alias("source_site"),
        F.lit("url").alias("source_url"))
    return ingest_plan.ingest(docs, meta, lens.nation_tables(s, sf)).stats


def stable_ids(s, sf):
    d = lens.table(s, sf, "documents")
    return d.select("doc_id", ids.stable_id(F.col("source"), F.col("lang"), F.lit("article"), F.col("doc_id").cast("string")).alias("id"))


def table_description(s, sf):
    return tables.table_descriptions(lens.table_meta(s, sf), lens.nation_tables(s, sf), 150)


def table_text(s, sf):
    return tables.table_texts(lens.nation_tables(s, sf))


def registry_upsert(s, sf):
    """Half of the nations registered before, all registered again: descriptions and marks survive."""
    n = lens.table_meta(s, sf).withColumn("k", F.substring("table_ref", 2, 9).cast("int"))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    values = {"jurisdiction": F.lit("KSA"), "is_current": F.lit(True), "corrected": F.col("k") % 3 == 0, "version_label": F.lit("old"),
              "description": F.concat(F.lit("about "), "table_ref"), "created_at": at}
    empty = s.createDataFrame([], stores.REGISTRY)
    old = n.filter("k % 2 = 0").select(*[values.get(f.name, F.col(f.name) if f.name in n.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                                        for f in empty.schema.fields])
    new = n.select("table_ref", "document_type", F.lit("new").alias("version_label"), "language")
    out = stores.upsert_registry(old, new, F.lit("2024-02-02 00:00:00").cast("timestamp"))
    return out.select("table_ref", "document_type", "version_label", "jurisdiction", "description", "corrected",
                      F.date_format("created_at", "yyyy-MM-dd").alias("created"))


def html_text(s, sf):
    return html.html_text(lens.table(s, sf, "pages")).select("page_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


# --- texts, sessions, notes ----------------------------------------------------------------------------------------------


def language_detect(s, sf):
    d = lens.table(s, sf, "documents")
    t = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(" ضريبة"))).otherwise(F.col("text"))
    return d.select("doc_id", text.language(t).alias("language"), text.needs_translation(t, F.lit("en")).alias("translate"))


def intent(s, sf):
    m = lens.messages(s, sf)
    t = F.when(F.col("seq") % 3 == 1, F.concat(F.lit("Calculate the tax. "), "content")).when(
        F.col("seq") % 3 == 2, F.concat(F.lit("Tell me about it. "), "content")).otherwise(F.col("content"))
    return m.select("thread_id", "seq", text.intent(t).alias("intent"))


def strip_markup(s, sf):
    return lens.table(s, sf, "documents").select("doc_id", F.md5(text.strip_latex(F.col("text"))).alias("text_md5"))


def stated_names(s, sf):
    m = lens.messages(s, sf)
    t = F.concat(F.when(F.col("seq") % 2 == 0, F.lit("Hi, my name is Dana Lee thanks. ")).otherwise(F.lit("Please call me Sam and help. ")), "content")
    return m.select("thread_id", "seq", text.stated_name(t).alias("name"))


def session_window(s, sf):
    return sessions.newest(lens.messages(s, sf), 3).select("thread_id", "seq", "role")


def wire_window(s, sf):
    return sessions.wire_window(lens.messages(s, sf), 4).select("thread_id", "seq", "role")


def last_question(s, sf):
    return sessions.last_user_message(lens.messages(s, sf)).select("thread_id", "seq", F.md5("content").alias("content_md5"))


def session_view(s, sf):
    return sessions.session_view(lens.messages(s, sf), 5, 3).select("thread_id", "history_size", "window_size", "language", "intent")


def _profile_updates(s, sf):
    e = lens.table(s, sf, "events")
    return e.select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 5 == 0, F.col("props")).alias("user_name"),
                    F.when(F.col("event_type") == "click", F.col("event_id").cast("string")).alias("email"),
                    F.lit(None).cast("string").alias("preferred_language"), F.col("event_type").alias("preferred_tone"),
                    F.lit(None).cast("string").alias("last_activity_summary"))


def merged_profiles(s, sf):
    return sessions.merged_profiles(_profile_updates(s, sf)).select("user_id", "user_name", "email", "preferred_tone")


def _said(df):
    return df.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


def latest_note(s, sf):
    return _said(notes.latest_notes(lens.notes(s, sf)))


def recent_activity(s, sf):
    e = lens.table(s, sf, "events").select("user_id", "event_id", "event_type", F.col("ts").alias("created_at"))
    return notes.newest_per_user(e, 5, tie="event_id").select("user_id", "event_id", "event_type", "rank")


def ilike_notes(s, sf):
    return _said(notes.customer_notes(lens.notes(s, sf), "u3", "omer#0000000_3", 10))


def note_answers(s, sf):
    n = lens.notes(s, sf)
    asks = lens.table(s, sf, "customer").select(
        F.col("c_custkey").alias("request_id"), F.concat(F.lit("u"), (F.col("c_custkey") % 20).cast("string")).alias("user_id"),
        F.when(F.col("c_custkey") % 4 != 0, F.lpad((F.col("c_custkey") + F.col("c_custkey") % 2).cast("string"), 9, "0")).alias("customer_name"))
    return notes.note_answers(asks, _said(n), 3)


def ttl_lookup(s, sf):
    """Batches visible at noon of day two to whoever asks: every second request is by the owner."""
    b = lens.batches(s, sf)
    asks = b.select("batch_id", F.when(F.substring("batch_id", -1, 1).isin("0", "2", "4", "6", "8"), F.col("user_id")).otherwise(
        "u0").alias("user_id"), "kind")
    now = F.lit("2024-01-02 12:00:00").cast("timestamp")
    return notes.visible_batches(b, asks, now).select("batch_id", "user_id", "kind", "status")


def batch_update(s, sf):
    b = lens.batches(s, sf)
    n = F.substring("batch_id", 2, 12).cast("bigint")
    u = b.filter(n % 3 == 0).select("batch_id", F.when(n % 2 == 0, F.col("user_id")).otherwise("nobody").alias("user_id"),
                                    F.lit("done").alias("status"), F.lit("{}").alias("data"))
    return stores.update_batches(b, u).groupBy("status", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("data") == "{}").alias("emptied"))


def memory_upsert(s, sf):
    """The first half of the events is stored, the second half merged in."""
    u = lens.memory_updates(s, sf)
    empty = s.createDataFrame([], "user_id string, customer_name string, customer_context string, issue_summary string, created_at timestamp, updated_at timestamp")
    stored = notes.upsert_memories(empty, u.filter("seq % 2 = 0"))
    return _memories(notes.upsert_memories(stored, u.filter("seq % 2 = 1")))


def _memories(out):
    return out.select("user_id", "customer_name", F.md5("customer_context").alias("context_md5"), "issue_summary",
                      F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"),
                      F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"))


def parsed_amounts(s, sf):
    """Amount text in several spellings, signed and absolute."""
    o = lens.table(s, sf, "orders")
    k, v = F.col("o_orderkey"), lens.cents("o_totalprice").cast("string")
    raw = F.when(k % 5 == 0, F.concat(F.lit("SAR "), v)).when(k % 5 == 1, F.concat(F.lit("("), v, F.lit(")"))).when(
        k % 5 == 2, F.concat(F.lit("-"), v)).when(k % 5 == 3, F.lit("12-34")).otherwise(F.concat(v, F.lit(" ر.س")))
    return o.select(k.alias("o_orderkey"), money.parse_signed(raw).cast("double").alias("signed"),
                    money.parse_absolute(raw).cast("double").alias("absolute"))


# --- files and stored tables ---------------------------------------------------------------------------------------------


def file_routes(s, sf):
    """A file per order, by extension: read as what, or turned away and why."""
    k = F.col("o_orderkey")
    ending = F.element_at(F.array(*map(F.lit, (".XML", ".csv", ".txt", ".md", ".pdf", "", ".tar.gz"))), (k % 7 + 1).cast("int"))
    accepted, rejected = files.route(lens.table(s, sf, "orders").select(F.concat(F.lit("/in/v1.2/f"), k.cast("string"), ending).alias("path")))
    return accepted.select("path", "format", F.lit(None).cast("string").alias("reason")).unionByName(
        rejected.select("path", F.lit(None).cast("string").alias("format"), "reason"))


def manifest_join(s, sf):
    """Manifests written as JSON arrays, read with their defaults, and joined to the files they name."""
    d = lens.table(s, sf, "documents").select("doc_id", "source", "lang")
    k = F.col("doc_id")
    name = F.concat(F.lit("docs/"), k.cast("string"), F.lit(".md"))
    entry = F.struct(name.alias("path"), F.col("source").alias("document_type"), F.col("lang").alias("language"),
                     F.when(k % 4 == 0, F.lit("v2")).alias("version_label"), F.when(k % 5 == 0, F.lit(False)).alias("is_current"))
    path = stored_path(s, "manifests")
    d.groupBy((k % 16).alias("part")).agg(F.to_json(F.collect_list(entry)).alias("value")).write.partitionBy("part").text(path)
    held = d.filter(k % 3 != 0).select(F.explode(F.array(F.concat(F.lit("/data/later/"), name), F.concat(F.lit("/data/"), name),
                                                         F.concat(F.lit("/data/x"), name))).alias("path"))
    joined, absent = files.join_manifest(files.read_manifest(s, path), held)
    told = ["path", "document_type", "language", "version_label", "is_current"]
    return joined.select(*told, "file_path", F.lit(None).cast("string").alias("reason")).unionByName(
        absent.select(*told, F.lit(None).cast("string").alias("file_path"), "reason"))


def first_tables(s, sf):
    """Of three tables per order the first with amounts, or the order named among those that have none."""
    k, head = F.col("o_orderkey"), lambda *names: F.array(*map(F.lit, names))
    i = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("table_index")
    meta = lens.table(s, sf, "orders").select(k.alias("document_id"), i).withColumn("column_names", F.when(
        (F.col("document_id") % 7 != 0) & ((F.col("document_id") + F.col("table_index")) % 3 == 0), head("Doc No", "Posting Date", "Amount"))
        .otherwise(head("Name", "City")))
    return ledgers.first_usable_table(meta).select("document_id", "table_index", F.lit(None).cast("string").alias("reason")).unionByName(
        ledgers.unusable_documents(meta).select("document_id", F.lit(None).cast("int").alias("table_index"), "reason"))


def _dispatched(s, sf):
    k = F.substring("filename", 5, 20).cast("bigint")
    return ledgers.dispatch(lens.invoices(s, sf).withColumn("n_tables", F.when(k % 9 == 0, F.lit(2)).when(k % 9 == 1, F.lit(0))))


def dispatch(s, sf):
    """Every document goes to its tables, to its lines, or is turned away."""
    with_tables, with_lines, rejected = _dispatched(s, sf)
    return with_tables.select("filename", F.lit("tables").alias("outcome")).unionByName(
        with_lines.select("filename", F.lit("lines").alias("outcome"))).unionByName(rejected.select("filename", F.col("reason").alias("outcome")))


def rows_from_invoices(s, sf):
    """Ledger rows of the invoices that go by their lines, numbered through; ordinals are told per file, as the lines of a file come in any order."""
    rows = ledgers.rows_from_invoices(_dispatched(s, sf)[1], "a")
    first = rows.groupBy("source_id").agg(F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"))
    return rows.join(first, "source_id").select("row_id", "reference", F.date_format("date", "yyyy-MM-dd").alias("date"), dbl("amount"), "description",
                                                "source_id", "first_ordinal", "last_ordinal")


def replaced_rows(s, sf):
    """The rows of all nation tables are stored, then those of every second table replaced by half of them."""
    path = stored_path(s, "table-rows")
    rows = lens.nation_tables(s, sf)
    stores.replace_table_rows(rows, path)
    even = F.substring("table_ref", 2, 9).cast("int") % 2 == 0
    stores.replace_table_rows(rows.filter(even & (F.col("row_index") % 2 == 0)), path)
    return stores.read_table_rows(s, path).select("table_ref", F.col("row_index").cast("bigint"), F.element_at("cells", 1)["value"].alias("supplier"))


def registry_changes(s, sf):
    """A registered table per supplier: descriptions set twice, corrections marked, one type listed."""
    k = F.col("s_suppkey")
    ref = F.concat(F.lit("s"), k.cast("string")).alias("table_ref")
    sup = lens.table(s, sf, "supplier")
    registry = stores.upsert_registry(s.createDataFrame([], stores.REGISTRY), sup.select(
        ref, F.when(k % 5 == 0, "rates").otherwise("lists").alias("document_type"), F.lit("en").alias("language")), F.lit("2024-01-01").cast("timestamp"))
    said = sup.filter(k % 2 == 0).select(ref, F.explode(F.array(F.lit("first"), F.lit("second"))).alias("description"))
    said = said.withColumn("set_at", F.when(F.col("description") == "first", 1).otherwise(2))
    marks = sup.filter(k % 3 == 0).select(ref, F.explode(F.array(F.lit("2024-05-01"), F.lit("2024-03-01"))).alias("corrected_date"))
    out = stores.list_tables(stores.mark_corrected(stores.set_descriptions(registry, said), marks), "lists")
    return out.select("table_ref", "document_type", "description", "corrected", "corrected_date", "is_current")


def memory_snapshots(s, sf):
    """The even events arrive, then the odd ones: two versions of a keyed table, the second read back."""
    path, u = stored_path(s, "memories"), lens.memory_updates(s, sf)
    stores.merge_snapshot(u.filter("seq % 2 = 0"), path, 1, jobs.MEMORY_KEYS, jobs.merge_memories)
    stores.merge_snapshot(u.filter("seq % 2 = 1"), path, 2, jobs.MEMORY_KEYS, jobs.merge_memories)
    return _memories(stores.latest_snapshot(s, path)[0])


def profile_snapshots(s, sf):
    """Profile updates in two batches in the order of the events, as a keyed table."""
    path, u = stored_path(s, "profiles"), _profile_updates(s, sf)
    half = u.agg(F.floor(F.max("seq") / 2)).first()[0] or 0
    stores.merge_snapshot(u.filter(F.col("seq") <= half), path, 1, ["user_id"], jobs.merge_profiles)
    stores.merge_snapshot(u.filter(F.col("seq") > half), path, 2, ["user_id"], jobs.merge_profiles)
    return stores.latest_snapshot(s, path)[0].select("user_id", "user_name", "email", "preferred_tone")


def point_snapshots(s, sf):
    """All documents are ingested, then every second one again with a new first article: its first point is replaced, the others stay."""
    path, docs = stored_path(s, "points"), _regulations(s, sf)
    again = docs.filter(F.col("document_type").cast("bigint") % 2 == 0).withColumn("text", F.lit("Article 1: new"))
    stores.merge_snapshot(jobs.arriving_points(docs), path, 1, ["id"], jobs.merge_points)
    stores.merge_snapshot(jobs.arriving_points(again), path, 2, ["id"], jobs.merge_points)
    return stores.latest_snapshot(s, path)[0].select("path", "article_number", "part_index", F.md5("text").alias("text_md5"))


def customer_memories(s, sf):
    """What is remembered of the customers of one user whose name holds a text, newest first."""
    return _memories(notes.customer_memories(notes.upsert_memories(s.createDataFrame([], jobs.MEMORY), lens.memory_updates(s, sf)), "u3", "I"))


def citations(s, sf):
    return retrieve.citations(_context(s, sf))


def item_numbers(s, sf):
    """Purchases with the numbers that a report shows."""
    return period.number_in_order(_period(s, sf).purchases, "number").select("source_id", "row_index", "number")


def filing_note(s, sf):
    """The note of a finished return; an unfinished one gives none."""
    made = _period(s, sf)
    note = period.filing_note(_decided(s, sf, made).headline, "u1", "Demo Trading", "2024-Q1").unionByName(
        period.filing_note(made.headline, "u1", "Unfinished", "2024-Q1"))
    return note.select("user_id", "customer_name", "status", "notes")


def workpapers(s, sf):
    """The datasets of the working papers, written as files in Arabic and read back."""
    path = stored_path(s, "report")
    made = _period(s, sf)
    reports.write_report(reports.workpapers(_decided(s, sf, made), made.issues, "ar"), path)
    head = s.read.parquet(f"{path}/headline").select(F.lit("headline").alias("dataset"), F.col("label").alias("name"), dbl("value"))
    left_out = s.read.parquet(f"{path}/excluded_purchases").groupBy(F.col("reason_code").alias("name")).agg(F.sum("vat_amount").cast("double").alias("value"))
    issues = s.read.parquet(f"{path}/issues").groupBy(F.col("issue").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    tagged = lambda df, name: df.select(F.lit(name).alias("dataset"), "name", "value")
    return head.unionByName(tagged(left_out, "excluded")).unionByName(tagged(issues.filter("name in ('total_differs', 'default_rate_assumed')"), "issues"))


def printed_numbers(s, sf):
    """VAT numbers, digits and names in lines of text, one line per customer."""
    k = F.col("c_custkey")
    number = F.concat(F.lit("3"), F.lpad((k * 7).cast("string"), 13, "0"), F.when(k % 3 == 0, "3").otherwise("4"))
    line = F.concat(F.col("c_name"), F.lit(" / VAT "), number, F.lit(", tel. "), F.translate(k.cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩"))
    return lens.table(s, sf, "customer").select(
        k.alias("c_custkey"), text.vat_number_in(line).alias("vat_number"), F.md5(text.western_digits(line)).alias("western_md5"),
        text.safe_file_name(F.col("c_name")).alias("file_name"), ids.table_ref(F.concat(F.lit("Rates Of "), F.col("c_mktsegment")), k).alias("table_ref"))


QUERIES = {f.__name__: f for f in (
    invoice_totals, line_vat, totals_mismatch, invoice_status, batch_counts, structural_issues, category_resolution,
    invoice_reasons, issue_detail, classification_split, payload_lines, result_roundtrip,
    match_reference, vat_gap, match_amount, fuzzy_candidates, fuzzy_classification, unmatched_rows, leftover_pool, stale_items,
    double_claims, invalid_selections, contested_groups, group_decisions, control_totals, summary_counts, exception_rows,
    exception_findings, sequential_references, group_options, group_matches, leftover_sums, reconcile_counts, register_scan, ledger_rows,
    normalized_references, description_tokens, parsed_amounts,
    register_rows, total_check, row_vat_check, reclaimability, period_headline, period_final, excluded_purchases, headline_rows,
    vector_topk, language_fallback, retrieve_context, cross_reference, reply_kinds, context_block, chunk_articles, chunk_references,
    chunk_fallback, ingest_points, stable_ids, table_description, table_text, registry_upsert, html_text,
    language_detect, intent, strip_markup, stated_names, session_window, wire_window, last_question, session_view, merged_profiles,
    latest_note, recent_activity, ilike_notes, note_answers, ttl_lookup, batch_update, memory_upsert,
    file_routes, manifest_join, first_tables, dispatch, rows_from_invoices, replaced_rows, registry_changes, memory_snapshots,
    profile_snapshots, point_snapshots, customer_memories, citations, item_numbers, filing_note, workpapers, printed_numbers,
)}
