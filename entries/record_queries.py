"""Registered queries on run history, access, payments, streams, rule checks and market figures."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import binding, entitlement as N, evidence, market, report, rulecheck, scoring
from attesta.operators import sources as S
from attesta.operators import store
from attesta.registry import Registry, load
from attesta.registry.tables import DA, SE
from attesta.session import shared_folder
from attesta.streaming import batches, events as EV
from attesta.streaming.tables import run_available, write_batch
from entries import base, chain
from entries.assessment_queries import OUTCOMES, scored, technical
from entries.base import q, read_table, register, sql_in
from entries.chain import RULES, sql, staged
from entries.post_queries import SQL_KEYS, record_sql, records, sql_first_posts


def folder_for(spark) -> str:
    return f"{shared_folder(spark)}/attesta/{uuid.uuid4().hex}"


# run history --------------------------------------------------------------------------------------


def order_runs(spark, folder):
    """Orders as assessment runs of customers."""
    state = (
        F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "REVIEW_REQUIRED")
        .otherwise("ASSESSMENT_PIPELINE_FAILED")
    )
    urgent = F.col("o_orderpriority") == "1-URGENT"
    orders = read_table(spark, folder, "orders").withColumn("state", state)
    done = F.col("state") == "COMPLETED"
    return orders.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("assessment_id"), "state",
        F.when(~done & ~urgent, F.col("state")).alias("error_code"),
        F.when(done, F.col("o_orderpriority")).alias("result"),
        F.when(F.col("state") != "ASSESSMENT_PIPELINE_FAILED", F.lit("{}")).alias("context"),
        F.when(F.col("state") == "REVIEW_REQUIRED", 1).otherwise(0).alias("n_flags"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"), "o_orderpriority",
    )


SQL_RUN_STATES = """order_runs AS (SELECT o_orderkey AS run_id, o_custkey AS assessment_id,
  CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'REVIEW_REQUIRED' ELSE 'ASSESSMENT_PIPELINE_FAILED' END AS state,
  o_orderdate AS created_at, o_orderpriority FROM orders)"""
SQL_LATEST = f"{SQL_RUN_STATES}, latest AS (SELECT assessment_id, run_id AS latest_run_id, state FROM (SELECT *, row_number() OVER (PARTITION BY assessment_id ORDER BY created_at DESC, run_id DESC) AS rn FROM order_runs) WHERE rn = 1)"


@register("b23_run_state_rules", f"WITH {SQL_RUN_STATES} SELECT run_id, state = 'COMPLETED' OR o_orderpriority <> '1-URGENT' AS consistent FROM order_runs")
def b23(spark, folder):
    return order_runs(spark, folder).select("run_id", store.run_state_consistent().alias("consistent"))


@register("e11_latest_run", f"WITH {SQL_LATEST} SELECT * FROM latest")
def e11(spark, folder):
    return store.latest_runs(order_runs(spark, folder))


@register("c20_latest_run_join", f"WITH {SQL_LATEST} SELECT c_custkey AS assessment_id, latest_run_id, state FROM customer JOIN latest ON assessment_id = c_custkey")
def c20(spark, folder):
    pointers = store.latest_runs(order_runs(spark, folder)).drop("state")
    assessments = read_table(spark, folder, "customer").select(F.col("c_custkey").alias("assessment_id")).join(pointers, "assessment_id")
    return store.latest_run_join(assessments, order_runs(spark, folder)).select("assessment_id", "latest_run_id", "state")


@register("b20_key_lookup", "SELECT o_orderkey AS run_id, o_orderstatus FROM orders WHERE o_custkey = 42")
def b20(spark, folder):
    rows = store.by_key(read_table(spark, folder, "orders"), "o_custkey", 42)
    return rows.select(F.col("o_orderkey").alias("run_id"), "o_orderstatus")


@register("b14_report_access", f"WITH {SQL_LATEST} SELECT c_custkey, CASE WHEN c_nationkey <> c_custkey % 3 THEN 'ASSESSMENT_NOT_OWNED' WHEN c_acctbal < 0 THEN 'REPORT_LOCKED' WHEN state IS NULL OR state <> 'COMPLETED' THEN 'ASSESSMENT_NOT_COMPLETED' END AS error_code FROM customer LEFT JOIN latest ON assessment_id = c_custkey")
def b14(spark, folder):
    latest = store.latest_runs(order_runs(spark, folder)).select(F.col("assessment_id").alias("c_custkey"), F.col("state").alias("run_state"))
    rows = read_table(spark, folder, "customer").join(latest, "c_custkey", "left").select(
        "c_custkey", F.lit(True).alias("found"), F.col("c_nationkey").cast("string").alias("owner_user_id"),
        F.pmod("c_custkey", F.lit(3)).cast("string").alias("user_id"),
        F.when(F.col("c_acctbal") < 0, "PREVIEW").otherwise("UNLOCKED").alias("access_state"), "run_state",
    )
    return rows.select("c_custkey", N.report_access().alias("error_code"))


def claims(spark, folder):
    """Orders as claims on the assessments of their customer."""
    token = F.when(F.col("o_orderstatus") == "P", F.lit("wrong")).otherwise(F.col("o_custkey").cast("string"))
    made = read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("assessment_id"),
        F.concat(F.lit("u"), F.pmod("o_orderkey", F.lit(4))).alias("user_id"), F.sha2(token, 256).alias("presented_hash"),
        F.col("o_orderdate").cast("timestamp").alias("claimed_at"),
    )
    owned = read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("assessment_id"), F.when(F.col("c_nationkey") == 0, "u1").alias("owner_user_id"),
        F.when(F.col("c_nationkey") != 0, F.sha2(F.col("c_custkey").cast("string"), 256)).alias("claim_token_hash"),
        F.when(F.col("c_acctbal") < 0, F.lit("1997-01-01").cast("timestamp")).alias("expires_at"),
    )
    return made, owned


SQL_CLAIMS = """claim_rows AS (SELECT o_orderkey AS claim_id, o_custkey AS assessment_id, 'u' || o_orderkey % 4 AS user_id, o_orderdate AS claimed_at,
  CASE WHEN c_custkey IS NULL THEN 'not_found' WHEN c_nationkey = 0 AND o_orderkey % 4 = 1 THEN 'idempotent' WHEN c_nationkey = 0 THEN 'conflict'
    WHEN o_orderstatus = 'P' THEN 'token_invalid' WHEN c_acctbal < 0 AND o_orderdate >= TIMESTAMP '1997-01-01' THEN 'expired' ELSE 'claimed' END AS status
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey),
winners AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY assessment_id ORDER BY claimed_at, claim_id) AS rn FROM claim_rows WHERE status = 'claimed') WHERE rn = 1),
decided AS (SELECT c.claim_id, c.assessment_id, c.user_id, CASE WHEN w.claim_id IS NULL OR (c.claimed_at, c.claim_id) <= (w.claimed_at, w.claim_id) THEN c.status
  WHEN w.user_id = c.user_id THEN 'idempotent' ELSE 'conflict' END AS status FROM claim_rows c LEFT JOIN winners w USING (assessment_id))"""


@register("b15_claim_validity", f"WITH {SQL_CLAIMS} SELECT claim_id, status FROM claim_rows")
def b15(spark, folder):
    made, owned = claims(spark, folder)
    rows = made.join(owned.withColumn("found", F.lit(True)), "assessment_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return rows.select("claim_id", N.claim_status().alias("status"))


@register("j7_claim_stream", f"WITH {SQL_CLAIMS} SELECT claim_id, status FROM decided")
def j7(spark, folder):
    """Two deliveries, split by the time of the claim."""
    made, owned = claims(spark, folder)
    source, out = folder_for(spark), folder_for(spark)
    early = F.col("claimed_at") < F.lit("1996-06-01").cast("timestamp")
    write_deliveries([made.filter(early), made.filter(~early)], source)
    stream = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(source)
    batches.claim_runs(stream, owned, f"{out}/table", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/table").select("claim_id", "status")


def digests(spark, folder, changed=False):
    """Digests of orders as runs with one source each and their lines as evidence, as they are or changed by key."""
    every = lambda col, n: F.lit(changed) & (F.pmod(col, F.lit(n)) == 0)
    runs = order_runs(spark, folder).select(
        "run_id", "assessment_id", "state", "error_code", F.lit("1").alias("pipeline_version"), F.lit("1.2.0").alias("contract_version"),
        F.lit("V2").alias("rubric_version"), F.lit(SE).alias("track"), F.lit("{}").alias("assessment_input"), F.col("context").alias("scoring_context"),
        "result", F.when(every("run_id", 13), "[1]").otherwise("[]").alias("review_flags"), F.lit("[]").alias("stages"),
    )
    sources = runs.select(
        "run_id", F.lit("cv").alias("source_type"), F.when(every("run_id", 5), "changed").otherwise("note").alias("notes"),
        F.when(every("run_id", 17), "2").otherwise("1").alias("extractor_version"),
    )
    lines = read_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("evidence_id"), F.col("l_partkey").alias("subject"),
        F.when(every("l_orderkey", 7) & (F.col("l_linenumber") == 1), "OPEN").otherwise("DONE").alias("review_status"),
    )
    return runs.select("run_id", "assessment_id").join(store.run_digests(runs, sources, lines), "run_id")


@register("g7_run_equivalence", """SELECT o_orderkey AS run_id, NOT (o_orderkey % 5 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0
  OR (o_orderkey % 7 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1))) AS equal FROM orders""")
def g7(spark, folder):
    then = digests(spark, folder, changed=True).select("run_id", F.col("digest").alias("other"))
    return digests(spark, folder).join(then, "run_id").select("run_id", (F.col("digest") == F.col("other")).alias("equal"))


@register("l10_run_store_merge", """WITH o AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE 'c' END AS ref, CASE WHEN o_orderkey % 19 = 0 THEN 2 ELSE 1 END AS bytes FROM orders),
known AS (SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'c' ELSE arg_min(ref, o_orderkey) END AS ref,
  CASE WHEN bool_or(o_orderstatus = 'F') THEN 1 ELSE arg_min(bytes, o_orderkey) END AS bytes FROM o GROUP BY 1)
SELECT o_orderkey AS run_id, CASE WHEN o.ref <> k.ref OR o.bytes <> k.bytes THEN 'conflict' WHEN o_orderstatus <> 'F' THEN 'inserted' WHEN o_orderkey % 5 = 0 THEN 'conflict' ELSE 'noop' END AS status
FROM o JOIN known k USING (o_custkey)""")
def l10(spark, folder):
    """Completed runs are stored; all come in, some changed, some for another candidate or with another document."""
    base_rows = digests(spark, folder)
    finished = order_runs(spark, folder).filter(F.col("state") == "COMPLETED").select("run_id")

    def described(df, ref, size):
        files = df.select("run_id", F.lit("cv").alias("document_id"), size.alias("byte_size"))
        return df.join(store.document_hash(files), "run_id").select(
            "run_id", "assessment_id", ref.alias("candidate_ref"), F.lit(SE).alias("track"), "document_hash", "digest"
        )

    existing = described(base_rows.join(finished, "run_id", "left_semi"), F.lit("c"), F.lit(1))
    changed = base_rows.withColumn(
        "digest", F.when(F.pmod("run_id", F.lit(5)) == 0, F.concat("digest", F.lit("x"))).otherwise(F.col("digest"))
    )
    ref = F.when(F.pmod("run_id", F.lit(3)) == 0, "x").otherwise("c")
    size = F.when(F.pmod("run_id", F.lit(19)) == 0, 2).otherwise(1)
    return store.merge_runs(described(changed, ref, size), existing).select("run_id", "status")


@register("j6_run_stream", """SELECT o_orderkey AS run_id, n AS seq, CASE WHEN o_orderkey % 5 = 0 AND n = 3 THEN 'conflict' WHEN n = 1 THEN 'inserted' ELSE 'noop' END AS status
FROM orders, (VALUES (1), (2), (3)) v(n)""")
def j6(spark, folder):
    """Two deliveries: every run twice in the first one, and once more, some changed, in the second."""
    rows = read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("assessment_id"), F.lit("c").alias("candidate_ref"),
        F.lit(SE).alias("track"), F.lit("h").alias("document_hash"), F.explode(F.array(*[F.lit(n).cast("long") for n in (1, 2, 3)])).alias("seq"),
        F.sha2(F.col("o_orderpriority"), 256).alias("digest"),
    )
    changed = (F.col("seq") == 3) & (F.pmod("run_id", F.lit(5)) == 0)
    rows = rows.withColumn("digest", F.when(changed, F.lit("x")).otherwise(F.col("digest")))
    source, out = folder_for(spark), folder_for(spark)
    write_deliveries([rows.filter("seq < 3"), rows.filter("seq = 3")], source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    batches.append_runs(stream, f"{out}/table", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/table").select("run_id", "seq", "status")


def _tree(spark, folder):
    st = staged(spark, folder)
    return store.run_tree(st.facts, base.sources(spark, folder), st.outcomes, base.runs(spark, folder))


@register("a13_persist_run_tree", sql("facts", "SELECT 'assessments' AS tab, count(*) AS n FROM runs UNION ALL SELECT 'documents', count(*) FROM runs UNION ALL SELECT 'runs', count(*) FROM runs UNION ALL SELECT 'sources', count(*) FROM sources UNION ALL SELECT 'evidence', count(*) FROM facts"))
def a13(spark, folder):
    path = folder_for(spark)
    store.write_run_tree(_tree(spark, folder), path)
    parts = [t.agg(F.lit(n).alias("tab"), F.count(F.lit(1)).alias("n")) for n, t in store.read_run_tree(spark, path).items()]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


@register("a14_run_with_children", sql("facts", "SELECT r.run_id, (SELECT string_agg(source_id, ',' ORDER BY source_id) FROM sources s WHERE s.run_id = r.run_id) AS source_ids, coalesce((SELECT string_agg(evidence_id, ',' ORDER BY evidence_id) FROM facts f WHERE f.run_id = r.run_id), '') AS evidence_ids, 'doc-' || r.run_id AS document_id FROM runs r"))
def a14(spark, folder):
    ids = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), ",")
    return store.run_with_children(_tree(spark, folder)).select(
        "run_id", ids("sources", "source_id").alias("source_ids"),
        F.coalesce(ids("evidence", "evidence_id"), F.lit("")).alias("evidence_ids"), "document_id",
    )


@register("f8_ordered_children", "SELECT conv_id, string_agg(role || ':' || length(text), ',' ORDER BY turn) AS turns FROM conversations GROUP BY 1")
def f8(spark, folder):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("n"))))
    return read_table(spark, folder, "conversations").groupBy("conv_id").agg(rows.alias("t")).select(
        "conv_id", F.array_join(F.transform("t", lambda x: F.concat(x.role, F.lit(":"), x.n)), ",").alias("turns")
    )


@register("a13_stored_results", sql("scores", f"""SELECT o.run_id, o.state, coalesce(x.flags, '') AS flags, x.triggers, x.run_id IS NOT NULL AS has_context,
  CASE WHEN o.state = 'COMPLETED' THEN s.raw_total END::BIGINT AS raw_total, CASE WHEN o.state = 'COMPLETED' THEN c.project_id END AS project_id,
  CASE WHEN o.error_code = 'EVIDENCE_NORMALIZATION_FAILED' THEN 5 ELSE 8 END AS n_stages, TRUE AS consistent
FROM ({OUTCOMES}) o LEFT JOIN context x ON x.run_id = o.run_id LEFT JOIN scored s ON s.run_id = o.run_id LEFT JOIN choices c ON c.run_id = o.run_id"""))
def a13_results(spark, folder):
    """Context, result, flags and stages of all runs, written and read back; the values come out of the stored JSON."""
    st, path = staged(spark, folder), folder_for(spark)
    store.stored_runs(base.runs(spark, folder), st.bindings, st.context, st.scored, st.outcomes).write.parquet(path)
    kept = spark.read.parquet(path)
    rows = kept.withColumns({"context": F.col("scoring_context"), "n_flags": F.size("review_flags")})
    triggers = F.array_join(F.from_json(F.get_json_object("context", "$.rule_triggers"), "array<string>"), ",")
    return rows.select(
        "run_id", "state", F.array_join("review_flags", ",").alias("flags"), triggers.alias("triggers"),
        F.col("context").isNotNull().alias("has_context"), F.get_json_object("result", "$.raw_total").cast("long").alias("raw_total"),
        F.get_json_object("result", "$.project_id").alias("project_id"), F.size("stages").alias("n_stages"),
        store.run_state_consistent().alias("consistent"),
    )


@register("a14_child_rows", sql("facts", """SELECT run_id, 'sources' AS part, source_id AS child_id, row_number() OVER (PARTITION BY run_id ORDER BY source_id)::INT AS child_no FROM sources
UNION ALL SELECT run_id, 'evidence', evidence_id, row_number() OVER (PARTITION BY run_id ORDER BY evidence_id)::INT FROM facts"""))
def a14_rows(spark, folder):
    path = folder_for(spark)
    store.write_children(store.run_children(_tree(spark, folder)), path)
    return spark.read.parquet(path).select("run_id", "part", "child_id", "child_no")


@register("f8_ordered_turns", "SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS child_no FROM conversations")
def f8_turns(spark, folder):
    turns = read_table(spark, folder, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return store.ordered_rows(turns, ["conv_id"], ["turn"]).select("conv_id", "turn", "n", "child_no")


@register("g6_canonical_links", "SELECT page_id AS run_id, page_id AS link_id, page_id % 3 = 0 AS ambiguous FROM pages")
def g6(spark, folder):
    pages = read_table(spark, folder, "pages")
    first = pages.select(F.col("page_id").alias("run_id"), F.lit(1).alias("link_ord"), F.col("page_id").alias("link_id"), F.col("url").alias("submitted_url"), F.lit("project").alias("declared_type"))
    again = pages.select(
        F.col("page_id").alias("run_id"), F.lit(2).alias("link_ord"), (F.col("page_id") + 100000).alias("link_id"),
        F.concat(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("#again")).alias("submitted_url"),
        F.when(F.pmod("page_id", F.lit(3)) == 0, "kaggle").otherwise("project").alias("declared_type"),
    )
    return store.canonical_links(first.unionByName(again)).select("run_id", "link_id", "ambiguous")


@register("c24_source_equality", sql("sources", "SELECT run_id, source_id, side FROM sources, (VALUES ('left'), ('right')) v(side) WHERE run_id % 10 = 3"))
def c24(spark, folder):
    left = base.sources(spark, folder)
    right = left.withColumn("locator", F.when(F.pmod("run_id", F.lit(10)) == 3, F.concat("locator", F.lit("?"))).otherwise(F.col("locator")))
    return S.source_differences(left, right, ["run_id", "source_id", "source_type", "locator"]).select("run_id", "source_id", "side")


@register("h49_cv_source_record", "SELECT 'doc-' || doc_id AS source_id, 'cv' AS source_type, 'accessible' AS access_status, 'attributed' AS ownership_status, sha256(text) AS content_hash, 'cv-1' AS extractor_version, '2026-01-01T00:00:00Z' AS retrieved_at, 'page 1' AS locator FROM documents")
def h49(spark, folder):
    rows = read_table(spark, folder, "documents")
    record = S.cv_source_record(F.concat(F.lit("doc-"), "doc_id"), F.lit("2026-01-01T00:00:00Z"), F.sha2("text", 256), F.lit("page 1"), F.lit("cv-1"))
    return rows.select(record.alias("r")).select("r.source_id", "r.source_type", "r.access_status", "r.ownership_status", "r.content_hash", "r.extractor_version", "r.retrieved_at", "r.locator")


@register("h50_link_source_record", "SELECT 'src-link-' || page_id AS source_id, 'project' AS source_type, 'unclear' AS ownership_status, url AS locator, 'link-1' AS extractor_version FROM pages")
@register("k1_link_retrievals", "SELECT 'src-link-' || page_id AS source_id, 'project' AS source_type, 'unclear' AS ownership_status, url AS locator, 'link-1' AS extractor_version FROM pages")
def h50(spark, folder):
    rows = read_table(spark, folder, "pages")
    record = S.link_source_record(
        F.concat(F.lit("link-"), "page_id"), F.lit("project"), F.col("url"), F.lit("2026-01-01T00:00:00Z"), F.lit("accessible"), F.sha2("html", 256),
        F.lit("link-1"),
    )
    return rows.select(record.alias("r")).select("r.source_id", "r.source_type", "r.ownership_status", "r.locator", "r.extractor_version")


@register("k1_retrievals_as_of", sql("sources", """SELECT run_id, source_id, CASE WHEN source_type = 'cv' THEN access_status WHEN run_id % 4 = 0 THEN 'inaccessible'
    WHEN run_id % 3 = 0 AND run_id % 2 = 0 THEN 'inaccessible' ELSE 'accessible' END AS access_status,
  CASE WHEN source_type = 'cv' THEN content_hash WHEN run_id % 4 = 0 OR (run_id % 3 = 0 AND run_id % 2 = 0) THEN NULL
    ELSE sha256(locator || CASE WHEN run_id % 2 = 0 THEN ' second' ELSE ' first' END) END AS content_hash FROM sources"""))
def k1_as_of(spark, folder):
    """Links retrieved twice: every third one is gone the second time. Even runs come after it, odd ones before it, and
    every fourth one before both."""
    all_sources = base.sources(spark, folder)
    at = lambda day: F.lit(f"2026-01-0{day} 00:00:00").cast("timestamp")
    n = lambda m: F.pmod("run_id", F.lit(m)) == 0
    runs = base.runs(spark, folder).select("run_id", F.when(n(4), at(1)).when(n(2), at(5)).otherwise(at(3)).alias("assessed_at"))
    links = all_sources.filter(F.col("source_type") != "cv")
    visit = lambda day, name, gone: links.select(
        "locator", at(day).alias("retrieved_at"), F.when(gone, "inaccessible").otherwise("accessible").alias("access_status"),
        F.when(~gone, F.sha2(F.concat("locator", F.lit(f" {name}")), 256)).alias("content_hash"),
    )
    retrievals = visit(2, "first", F.lit(False)).unionByName(visit(4, "second", n(3)))
    seen, _ = S.with_retrievals(all_sources, base.blocks(spark, folder), runs, retrievals)
    return seen.select("run_id", "source_id", "access_status", "content_hash")


@register("h40_canonical_json", "SELECT o_orderkey AS run_id, to_json({'o_custkey': o_custkey, 'o_orderpriority': o_orderpriority, 'o_orderstatus': o_orderstatus})::VARCHAR AS document FROM orders")
def h40(spark, folder):
    rows = read_table(spark, folder, "orders")
    return rows.select(F.col("o_orderkey").alias("run_id"), store.canonical_json(["o_orderstatus", "o_orderpriority", "o_custkey"]).alias("document"))


# payments -----------------------------------------------------------------------------------------


@register("a15_webhook_events", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'rejected' WHEN event_type <> 'purchase' THEN 'acknowledged' WHEN user_id % 9 = 0 THEN 'rejected' ELSE 'fulfil' END AS answer FROM events")
@register("j4_event_filter", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'rejected' WHEN event_type <> 'purchase' THEN 'acknowledged' WHEN user_id % 9 = 0 THEN 'rejected' ELSE 'fulfil' END AS answer FROM events")
def a15(spark, folder):
    source, out = folder_for(spark), folder_for(spark)
    name = F.when(F.col("event_type") == "purchase", N.SUCCESS_EVENT).when(F.col("event_type") != "error", F.col("event_type"))
    reference = F.when(F.pmod("user_id", F.lit(9)) == 0, F.lit("  ")).otherwise(F.concat(F.lit("ref-"), "user_id"))
    read_table(spark, folder, "events").select(
        "event_id", F.to_json(F.struct(name.alias("event"), F.struct(reference.alias("reference")).alias("data"))).alias("body")
    ).write.json(source)
    stream = N.webhook_events(spark.readStream.schema("event_id long, body string").json(source))
    run_available(stream, lambda df, n: write_batch(df, f"{out}/table", n), f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/table").select("event_id", "answer")


def write_deliveries(parts, path):
    """Write the parts one after the other, one file each: a stream reads them in this order."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)


@register("j1_exactly_once_unlock", """WITH bought AS (SELECT event_id, user_id, ts, user_id || '-' || event_id % 3 AS tx,
    CASE WHEN event_id % 5 = 0 THEN 2 ELSE event_id % 2 END AS delivery, event_id % 7 <> 0 AND event_id % 13 <> 0 AND user_id % 10 <> 0 AS fits, user_id % 11 <> 0 AS done
  FROM events WHERE event_type = 'purchase' AND user_id % 9 <> 0),
winners AS (SELECT user_id, arg_min(event_id, (delivery, ts, event_id)) AS won FROM bought WHERE fits AND done GROUP BY 1),
missing AS (SELECT event_id FROM events WHERE event_type = 'purchase' AND user_id % 9 = 0)
SELECT b.event_id, CASE WHEN NOT b.fits THEN 'conflict' WHEN NOT b.done THEN 'not_completed' WHEN b.event_id = w.won THEN 'unlocked' WHEN b.tx = v.tx THEN 'idempotent' ELSE 'conflict' END AS outcome
FROM bought b LEFT JOIN winners w USING (user_id) LEFT JOIN bought v ON v.event_id = w.won
UNION ALL SELECT event_id, 'not_found' FROM missing""")
def j1(spark, folder):
    """Three deliveries: every fifth event comes hours late, every fourth one twice, some with a wrong sum."""
    source, out = folder_for(spark), folder_for(spark)
    events = read_table(spark, folder, "events")
    every = lambda n: F.pmod("event_id", F.lit(n)) == 0
    bought = events.filter(F.col("event_type") == "purchase").select(
        "event_id", F.concat(F.lit("ref-"), "user_id").alias("reference"),
        F.concat(F.lit("tx-"), "user_id", F.lit("-"), F.pmod("event_id", F.lit(3))).alias("transaction_id"),
        F.col("ts").cast("timestamp").alias("paid_at"),
        F.when(every(7), 100).otherwise(N.PRODUCT["amount_minor"]).alias("amount_minor"),
        F.when(every(13), "USD").otherwise(N.PRODUCT["currency"]).alias("currency"),
    )
    late, odd = every(5), F.pmod("event_id", F.lit(2)) == 1
    write_deliveries([bought.filter(~late & ~odd), bought.filter(~late & odd), bought.filter(late | every(4))], source)
    users = events.select("user_id").distinct().filter(F.pmod("user_id", F.lit(9)) != 0)
    who = F.concat(F.lit("u-"), "user_id")
    payments = users.select(
        F.concat(F.lit("pay-"), "user_id").alias("payment_id"), F.col("user_id").alias("assessment_id"), who.alias("owner_user_id"),
        *[F.lit(N.PRODUCT[c]).alias(c) for c in ("product_id", "billing_model", "provider", "amount_minor", "currency")],
        F.concat(F.lit("ref-"), "user_id").alias("provider_reference"), F.lit("INITIALIZED").alias("status"),
        F.lit(None).cast("string").alias("provider_transaction_id"),
    )
    assessments = users.select(
        F.col("user_id").alias("assessment_id"), F.when(F.pmod("user_id", F.lit(10)) == 0, "other").otherwise(who).alias("owner_user_id"),
        F.when(F.pmod("user_id", F.lit(11)) == 0, "FAILED").otherwise("COMPLETED").alias("run_state"),
    )
    stream = spark.readStream.schema(bought.schema).option("maxFilesPerTrigger", 1).parquet(source)
    EV.unlock(stream, payments, assessments, f"{out}/table", f"{out}/checkpoint")
    return EV.latest_outcomes(spark.read.parquet(f"{out}/table"))


@register("j1_retried_unlock", """WITH bought AS (SELECT event_id, user_id, ts, event_id % 3 AS tx FROM events WHERE event_type = 'purchase'),
delivered AS (SELECT b.*, n, n > user_id % 4 AS there, n > user_id % 3 AS done FROM bought b, (VALUES (1), (2), (3)) v(n)
  WHERE n = 2 OR (n = 1 AND event_id % 2 = 0) OR (n = 3 AND event_id % 5 <> 0)),
winners AS (SELECT user_id, arg_min(event_id, (n, ts, event_id)) AS won, arg_min(tx, (n, ts, event_id)) AS won_tx FROM delivered WHERE there AND done GROUP BY 1),
answered AS (SELECT *, min(n) FILTER (there AND done) OVER (PARTITION BY event_id) AS final FROM delivered)
SELECT a.n AS delivery, a.event_id, CASE WHEN NOT there THEN 'not_found' WHEN NOT done THEN 'not_completed' WHEN a.event_id = w.won THEN 'unlocked' WHEN a.tx = w.won_tx THEN 'idempotent' ELSE 'conflict' END AS outcome
FROM answered a LEFT JOIN winners w USING (user_id) WHERE final IS NULL OR a.n <= final""")
def j1_retried(spark, folder):
    """Three deliveries that repeat events, while payments and completed runs appear between them."""
    source, out = folder_for(spark), folder_for(spark)
    events = read_table(spark, folder, "events")
    bought = events.filter(F.col("event_type") == "purchase").select(
        "event_id", F.concat(F.lit("ref-"), "user_id").alias("reference"),
        F.concat(F.lit("tx-"), "user_id", F.lit("-"), F.pmod("event_id", F.lit(3))).alias("transaction_id"),
        F.col("ts").cast("timestamp").alias("paid_at"), F.lit(N.PRODUCT["amount_minor"]).alias("amount_minor"),
        F.lit(N.PRODUCT["currency"]).alias("currency"),
    )
    every = lambda n: F.pmod("event_id", F.lit(n)) == 0
    users = events.select("user_id").distinct()
    who = F.concat(F.lit("u-"), "user_id")
    for n, part in enumerate([bought.filter(every(2)), bought, bought.filter(~every(5))], 1):
        write_deliveries([part], source)
        payments = users.filter(F.pmod("user_id", F.lit(4)) < n).select(
            F.concat(F.lit("pay-"), "user_id").alias("payment_id"), F.col("user_id").alias("assessment_id"), who.alias("owner_user_id"),
            *[F.lit(N.PRODUCT[c]).alias(c) for c in ("product_id", "billing_model", "provider", "amount_minor", "currency")],
            F.concat(F.lit("ref-"), "user_id").alias("provider_reference"), F.lit("INITIALIZED").alias("status"),
            F.lit(None).cast("string").alias("provider_transaction_id"),
        )
        assessments = users.select(
            F.col("user_id").alias("assessment_id"), who.alias("owner_user_id"),
            F.when(F.pmod("user_id", F.lit(3)) < n, "COMPLETED").otherwise("RUNNING").alias("run_state"),
        )
        stream = spark.readStream.schema(bought.schema).parquet(source)
        EV.unlock(stream, payments, assessments, f"{out}/table", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/table").select((F.col("batch") + 1).cast("int").alias("delivery"), "event_id", "outcome")


CHANGES = {"signup": "created", "click": "initialized", "error": "failed", "purchase": "succeeded"}
SQL_CHANGES = "changes AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'created' WHEN 'click' THEN 'initialized' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' END AS change FROM events WHERE event_type <> 'view')"


@register("j2_attempt_lifecycle", f"""WITH {SQL_CHANGES}, c AS (SELECT user_id, min(event_id) AS created FROM changes WHERE change = 'created' GROUP BY 1),
m AS (SELECT user_id, coalesce(min(event_id) FILTER (change = 'initialized'), 1e15) AS i, coalesce(min(event_id) FILTER (change = 'failed'), 1e15) AS f, coalesce(min(event_id) FILTER (change = 'succeeded'), 1e15) AS s
  FROM changes JOIN c USING (user_id) WHERE event_id >= created GROUP BY 1)
SELECT user_id AS payment_id, CASE WHEN f < i AND f < s THEN 'INITIALIZATION_FAILED' WHEN s < 1e15 THEN 'SUCCEEDED' WHEN i < 1e15 THEN 'INITIALIZED' ELSE 'INITIALIZING' END AS state FROM m""")
def j2(spark, folder):
    change = F
    for kind, name in CHANGES.items():
        change = change.when(F.col("event_type") == kind, name)
    rows = read_table(spark, folder, "events").select(F.col("user_id").alias("payment_id"), F.col("event_id").alias("seq"), change.alias("change"))
    return N.attempt_states(rows.filter(F.col("change").isNotNull()))


@register("j3_checkout_attempts", """WITH RECURSIVE ev AS (SELECT user_id AS owner, event_id, ts,
    CASE event_type WHEN 'click' THEN 'initialized' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' ELSE 'checkout' END AS kind,
    row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END, ts, event_id) AS n FROM events),
st AS (
  SELECT DISTINCT owner, 0::BIGINT AS n, NULL::BIGINT AS event_id, 'NONE' AS status, TIMESTAMP '1970-01-01' AS updated, NULL::VARCHAR AS reply FROM ev
  UNION ALL
  SELECT owner, n, event_id,
    CASE WHEN reply = 'created' THEN 'INITIALIZING' WHEN reply IS NOT NULL THEN status
      WHEN status = 'INITIALIZING' AND kind = 'initialized' THEN 'INITIALIZED' WHEN status = 'INITIALIZING' AND kind = 'failed' THEN 'INITIALIZATION_FAILED'
      WHEN status IN ('INITIALIZING', 'INITIALIZED') AND kind = 'succeeded' THEN 'SUCCEEDED' ELSE status END,
    CASE WHEN reply = 'created' OR (reply IS NULL AND ((status = 'INITIALIZING' AND kind <> 'checkout') OR (status = 'INITIALIZED' AND kind = 'succeeded'))) THEN ts ELSE updated END,
    reply
  FROM (SELECT ev.*, st.status, st.updated, CASE WHEN kind <> 'checkout' THEN NULL WHEN status = 'SUCCEEDED' THEN 'already_unlocked' WHEN status = 'INITIALIZED' THEN 'existing_initialized'
      WHEN status = 'INITIALIZING' AND ts - updated < INTERVAL 30 SECOND THEN 'initializing' ELSE 'created' END AS reply
    FROM st JOIN ev ON ev.owner = st.owner AND ev.n = st.n + 1))
SELECT owner, event_id, reply AS outcome FROM st WHERE reply IS NOT NULL""")
def j3(spark, folder):
    """Two deliveries: every tenth change comes after all others, however old it is."""
    kind = F
    for name, value in (CHANGES | {"signup": "checkout", "view": "checkout"}).items():
        kind = kind.when(F.col("event_type") == name, value)
    source, out = folder_for(spark), folder_for(spark)
    rows = read_table(spark, folder, "events").select(F.col("user_id").alias("owner"), "event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"))
    late = F.pmod("event_id", F.lit(10)) == 0
    write_deliveries([rows.filter(~late), rows.filter(late)], source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    EV.follow_checkouts(stream, f"{out}/table", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/table").select("owner", "event_id", "outcome")


@register("h43_expiry_and_stale", "SELECT event_id, ts <= TIMESTAMP '2024-01-10' AS expired, event_type = 'signup' AND TIMESTAMP '2024-01-10' - ts >= INTERVAL 30 SECOND AS stale FROM events")
def h43(spark, folder):
    now, ts = F.lit("2024-01-10").cast("timestamp"), F.col("ts").cast("timestamp")
    status = F.when(F.col("event_type") == "signup", "INITIALIZING").otherwise("INITIALIZED")
    return read_table(spark, folder, "events").select(
        "event_id", N.expired(ts, now).alias("expired"), N.stale_attempt(status, ts, now).alias("stale")
    )


@register("h41_parse_rfc3339", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 2 HOUR END AS at FROM events")
def h41(spark, folder):
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    n = F.pmod("event_id", F.lit(4))
    text = F.when(n == 0, F.concat(ts, F.lit("Z"))).when(n == 1, F.concat(ts, F.lit("+02:00"))).when(n == 2, ts).otherwise(F.replace(ts, F.lit("T"), F.lit(" ")))
    local = N.parse_rfc3339(text).cast("timestamp_ntz")
    at = F.convert_timezone(F.current_timezone(), F.lit("UTC"), local)
    return read_table(spark, folder, "events").select("event_id", at.alias("at"))


@register("h54_usable_email", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'c' || c_custkey || '@example.com' END AS email FROM customer")
def h54(spark, folder):
    n = F.pmod("c_custkey", F.lit(3))
    text = F.when(n == 0, F.concat(F.lit(" c"), "c_custkey", F.lit("@example.com "))).when(n == 1, F.concat(F.lit("a b@"), "c_name")).otherwise(F.col("c_name"))
    return read_table(spark, folder, "customer").select("c_custkey", N.usable_email(text).alias("email"))


def payments(spark, folder):
    """Events as payment rows of their user."""
    status = F.when(F.col("event_type") == "purchase", "SUCCEEDED").when(F.col("event_type") == "click", "INITIALIZED").when(F.col("event_type") == "signup", "INITIALIZING").otherwise("INITIALIZATION_FAILED")
    return read_table(spark, folder, "events").select(
        F.col("event_id").alias("payment_id"), F.col("user_id").alias("assessment_id"), F.lit("readiness_report_v1").alias("product_id"), status.alias("status"),
        F.when(F.pmod("event_id", F.lit(3)) != 0, F.col("ts").cast("timestamp")).alias("paid_at"),
    )


@register("e7_latest_payment", "SELECT user_id AS assessment_id, event_id AS payment_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 3 <> 0 THEN ts END DESC NULLS LAST, event_id DESC) AS rn FROM events WHERE event_type = 'purchase') WHERE rn = 1")
def e7(spark, folder):
    return N.latest_succeeded(payments(spark, folder)).select("assessment_id", "payment_id")


@register("e12_one_active_checkout", "SELECT user_id AS assessment_id, count(*) AS n_active FROM events WHERE event_type IN ('click', 'signup') GROUP BY 1 HAVING count(*) > 1")
def e12(spark, folder):
    return N.active_violations(payments(spark, folder)).select("assessment_id", "n_active")


@register("c21_payment_match", "SELECT o_orderkey AS payment_id, c_nationkey = o_custkey % 25 AND o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' AS matches FROM orders JOIN customer ON c_custkey = o_custkey")
def c21(spark, folder):
    customer = read_table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("assessment_owner"))
    rows = read_table(spark, folder, "orders").join(customer, "o_custkey").select(
        F.col("o_orderkey").alias("payment_id"), F.pmod("o_custkey", F.lit(25)).alias("owner_user_id"), "assessment_owner",
        F.lit("readiness_report_v1").alias("product_id"), F.lit("one_time").alias("billing_model"), F.lit("paystack").alias("provider"),
        F.lit("r").alias("provider_reference"), F.lit("r").alias("event_reference"), F.lit(15900).alias("amount_minor"),
        F.when(F.col("o_orderstatus") == "F", 15900).otherwise(1).alias("event_amount"), F.lit("ZAR").alias("currency"),
        F.when(F.col("o_orderpriority") == "5-LOW", "USD").otherwise("ZAR").alias("event_currency"),
    )
    return rows.select("payment_id", N.payment_matches().alias("matches"))


@register("b21_product_check", "SELECT p_partkey, p_size > 10 AND p_brand <> 'Brand#11' AS approved FROM part")
def b21(spark, folder):
    rows = read_table(spark, folder, "part").select(
        "p_partkey", *[F.lit(v).alias(k) for k, v in N.PRODUCT.items() if k not in ("amount_minor", "currency")],
        F.when(F.col("p_size") > 10, 15900).otherwise(F.col("p_size")).alias("amount_minor"),
        F.when(F.col("p_brand") == "Brand#11", "USD").otherwise("ZAR").alias("currency"),
    )
    return rows.select("p_partkey", N.product_approved().alias("approved"))


# checks -------------------------------------------------------------------------------------------


@register("d16_uniqueness", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def d16(spark, folder):
    return store.duplicated(read_table(spark, folder, "events"), ["user_id", "event_type"])


@register("h33_level_rank", sql("technical", "SELECT evidence_level, attribution_status, CASE evidence_level WHEN 'demonstrated' THEN 3 WHEN 'documented' THEN 2 ELSE 1 END AS level_rank, CASE attribution_status WHEN 'attributed' THEN 3 WHEN 'unclear' THEN 2 ELSE 1 END AS attribution_rank, count(*) AS n FROM technical GROUP BY ALL"))
def h33(spark, folder):
    return technical(spark, folder).groupBy(
        "evidence_level", "attribution_status", evidence.level_rank(F.col("evidence_level")).alias("level_rank"),
        evidence.attribution_rank(F.col("attribution_status")).alias("attribution_rank"),
    ).agg(F.count(F.lit(1)).alias("n"))


@register("h48_row_validation", "SELECT o_orderkey, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'ENUM' WHEN NOT regexp_matches(o_orderpriority, '^[1-4]-') THEN 'PATTERN' WHEN o_totalprice <= 50000 THEN 'RANGE' END AS error_code FROM orders")
def h48(spark, folder):
    rules = [
        ("ENUM", F.col("o_orderstatus").isin("F", "O")), ("PATTERN", F.col("o_orderpriority").rlike("^[1-4]-")),
        ("RANGE", F.col("o_totalprice") > 50000),
    ]
    return rulecheck.validate(read_table(spark, folder, "orders"), rules).select("o_orderkey", "error_code")


@register("b3_track_filter", "SELECT doc_id, CASE WHEN source NOT IN ('src0', 'src1') THEN 'INVALID_TRACK' END AS error_code FROM documents")
def b3(spark, folder):
    track = F.when(F.col("source") == "src0", SE).when(F.col("source") == "src1", DA).otherwise(F.col("source"))
    rows = read_table(spark, folder, "documents").select("doc_id", track.alias("track"))
    return rulecheck.validate(rows, [("INVALID_TRACK", F.col("track").isin(SE, DA))]).select("doc_id", "error_code")


@register("b17_scoring_input", sql("bindings", "SELECT run_id, CASE WHEN run_id % 5 = 1 THEN 'TRACK_INVALID' WHEN run_id % 5 = 2 THEN 'INPUT_INVALID' WHEN run_id % 5 = 3 THEN 'INPUT_INVALID' END AS error_code FROM bindings GROUP BY 1"))
def b17(spark, folder):
    st = staged(spark, folder)
    n = F.pmod("run_id", F.lit(5))
    grouped = st.bindings.groupBy("run_id").agg(F.collect_list(F.struct("criterion_id", "anchor", "n_evidence")).alias("bindings"))
    rows = grouped.join(base.runs(spark, folder).select("run_id", "track"), "run_id").select(
        "run_id", F.when(n == 1, "other").otherwise(F.col("track")).alias("track"),
        F.when(n == 2, "1.0.0").otherwise("1.2.0").alias("contract_version"), F.lit("V2").alias("rubric_version"),
        F.when(n == 3, F.concat("bindings", "bindings")).otherwise(F.col("bindings")).alias("bindings"),
    )
    return rulecheck.validate(rows, rulecheck.scoring_input_rules()).select("run_id", "error_code")


@register("c23_foreign_keys", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def c23(spark, folder):
    return rulecheck.unknown_keys(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"), "doc_id", "doc_id")


@register("c25_unique_rule", sql("facts", "SELECT f.subject, f.fact_type, any_value(p.rule_id) AS rule_id, bool_and(p.rule_id = f.rule_id) AS agrees FROM facts f JOIN provenance p ON p.subject = f.subject AND p.fact_type = f.fact_type GROUP BY 1, 2", chain.PROVENANCE))
def c25(spark, folder):
    rules = rulecheck.unique_rules(RULES.table(spark, "provenance")).withColumnRenamed("rule_id", "known_rule")
    rows = staged(spark, folder).facts.join(F.broadcast(rules), ["subject", "fact_type"])
    return rows.groupBy("subject", "fact_type").agg(
        F.first("known_rule").alias("rule_id"), F.bool_and(F.col("known_rule") == F.col("rule_id")).alias("agrees")
    )


@register("d18_weight_sums", "SELECT p_brand, sum(p_size)::BIGINT AS total FROM part GROUP BY 1")
def d18(spark, folder):
    return rulecheck.weight_sums(read_table(spark, folder, "part"), "p_brand", "p_size")


@register("d19_band_coverage", sql("scores", "SELECT run_id, final_score IN (39, 59, 79) AS unclear FROM scored"))
def d19(spark, folder):
    """Every band begins one score too early, so the last scores of the bands before it have two."""
    bands = RULES.table(spark, "band").select(F.greatest(F.col("min_score") - 1, F.lit(0)).alias("min_score"), "max_score")
    unclear = rulecheck.band_coverage(bands).select(F.col("score").alias("final_score"), F.lit(True).alias("unclear"))
    return scored(spark, folder).join(F.broadcast(unclear), "final_score", "left").select("run_id", F.coalesce("unclear", F.lit(False)).alias("unclear"))


@register("g5_recognised_ids", "SELECT user_id, coalesce(string_agg(DISTINCT CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN event_type END, ',' ORDER BY CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN event_type END), '') AS unknown FROM events GROUP BY 1")
def g5(spark, folder):
    types = read_table(spark, folder, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("types"))
    unknown = rulecheck.unrecognised(F.col("types"), ["view", "click", "purchase"])
    return types.select("user_id", F.array_join(unknown, ",").alias("unknown"))


@register("l9_rule_violations", sql("facts", "SELECT run_id, evidence_id, CASE fact_no % 10 WHEN 1 THEN 'UNKNOWN_SUBJECT' WHEN 2 THEN 'UNKNOWN_RULE_ID' WHEN 3 THEN 'MISMATCHED_EVIDENCE_FACT' WHEN 4 THEN 'UNKNOWN_SOURCE' END AS error_code FROM facts WHERE fact_no % 10 BETWEEN 1 AND 4"))
def l9(spark, folder):
    n = F.pmod("fact_no", F.lit(10))
    facts = staged(spark, folder).facts.select(
        "run_id", "evidence_id", F.when(n == 1, "nothing").otherwise(F.col("subject")).alias("subject"),
        F.when(n == 2, "nothing").otherwise(F.col("rule_id")).alias("rule_id"),
        F.when(n == 3, "nothing").otherwise(F.col("fact_type")).alias("fact_type"),
        F.when(n == 4, "nothing").otherwise(F.col("source_id")).alias("source_id"),
    )
    return binding.fact_errors(facts, base.sources(spark, folder))


@register("a10_rule_documents", sql("raw", "SELECT kind, count(*) AS n FROM raw_facts f JOIN (SELECT DISTINCT subject, kind FROM alias) a USING (subject) GROUP BY 1"))
def a10(spark, folder):
    import json

    kinds = {}
    for kind, subject, aliases in RULES.subject_aliases:
        entry = {
            "subject": subject, "kind": kind, "rule_id": f"normalize.v1.{kind}.{subject}",
            "aliases": [{"text": a, "case_sensitive": a in RULES.case_sensitive} for a in aliases],
        }
        kinds.setdefault("qualifications" if kind == "qualification" else "subjects", []).append(entry)
    path = folder_for(spark)
    spark.createDataFrame([(json.dumps(kinds),)], "value string").write.text(path)
    loaded = load.alias_table(load.read_document(spark, path)).select("subject", "kind").distinct()
    raw = evidence.raw_technical_facts(staged(spark, folder).sentences)
    return raw.join(F.broadcast(loaded), "subject").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


WORDS = Registry(
    action_cues=("with", "from"),
    subject_aliases=(("skill", "of_phrase", ("of", "of the")), ("tool", "that_word", ("that",)), ("tool", "this_word", ("this", "that the"))),
    case_sensitive=(),
)


@register("k2_other_rules", base.with_ctes(
    base.SQL_RUNS, base.SQL_CV_BLOCKS, f"s AS (SELECT run_id, source_ord, block_ord, unnest({base.sql_sentences('text')}) AS sentence FROM cv_blocks)",
    "h AS (SELECT run_id, regexp_matches(sentence, '(?i)\\b(?:with|from)\\b') AS applied, unnest(regexp_extract_all(sentence, '(?i)\\b(?:of the|that the|that|this|of)\\b')) AS hit FROM s)",
    "SELECT CASE WHEN lower(hit) LIKE 'of%' THEN 'of_phrase' WHEN lower(hit) = 'that' THEN 'that_word' ELSE 'this_word' END AS subject, CASE WHEN lower(hit) LIKE 'of%' THEN 'skill' ELSE 'tool' END || CASE WHEN applied THEN '_application' ELSE '_name' END AS fact_type, count(*) AS n FROM h GROUP BY 1, 2"))
def k2(spark, folder):
    sentences = evidence.scan_sentences(base.cv_blocks(spark, folder), WORDS)
    return evidence.raw_technical_facts(sentences, WORDS).groupBy("subject", "fact_type").agg(F.count(F.lit(1)).alias("n"))


@register("k3_given_identity", "SELECT doc_id AS run_id, 'run-' || substr(sha256(doc_id || '|' || source), 1, 12) AS given_id FROM documents")
def k3(spark, folder):
    rows = read_table(spark, folder, "documents")
    return rows.select(F.col("doc_id").alias("run_id"), store.given_id("run-", "doc_id", "source").alias("given_id"))


# volume: the same scoring steps over order lines ------------------------------------------------------


@register("d5_line_totals", "SELECT l_orderkey, sum(l_quantity::INT)::BIGINT AS raw_total, least(sum(l_quantity::INT), CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 59 ELSE 100 END)::BIGINT AS final_score FROM lineitem GROUP BY 1")
def d5_lines(spark, folder):
    sums = read_table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_quantity").cast("int")).alias("raw_total"), F.bool_or(F.col("l_returnflag") == "R").alias("capped")
    )
    return sums.select("l_orderkey", "raw_total", F.least("raw_total", F.when(F.col("capped"), 59).otherwise(100)).alias("final_score"))


@register("f1_line_top5", "SELECT l_orderkey, l_linenumber, rn FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_quantity DESC, l_linenumber) AS rn FROM lineitem) WHERE rn <= 5")
def f1_lines(spark, folder):
    order = Window.partitionBy("l_orderkey").orderBy(F.desc("l_discount"), F.desc("l_quantity"), "l_linenumber")
    rows = read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_quantity")
    return rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= 5).select("l_orderkey", "l_linenumber", "rn")


@register("h37_line_percent", "SELECT l_orderkey, l_linenumber, ((l_quantity::INT * 200 + 50) // 100)::INT AS percentage FROM lineitem")
def h37_lines(spark, folder):
    return read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", report.whole_percent(F.col("l_quantity").cast("int"), F.lit(50)).alias("percentage")
    )


@register("h29_line_bands", "SELECT CASE WHEN s <= 39 THEN 'limited_application_evidence' WHEN s <= 59 THEN 'foundation_visible' WHEN s <= 79 THEN 'developing_application_readiness' ELSE 'strong_application_evidence' END AS band, count(*) AS n FROM (SELECT l_quantity::INT * 2 AS s FROM lineitem) GROUP BY 1")
def h29_lines(spark, folder):
    band = scoring.band_for(F.col("l_quantity").cast("int") * 2)
    return read_table(spark, folder, "lineitem").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


# market -------------------------------------------------------------------------------------------

LABELS = ["primary_skills", "secondary_skills", "tools"]
SQL_LABELS = "post_labels AS (SELECT DISTINCT page_id, track, label FROM (SELECT page_id, track, unnest(string_split(concat_ws(', ', nullif(primary_skills, ''), nullif(secondary_skills, ''), nullif(tools, '')), ', ')) AS label FROM record) WHERE label <> '')"


@register("m1_label_frequency", record_sql("SELECT track, label, count(*) AS n_posts, (SELECT count(*) FROM record r WHERE r.track = p.track) AS n_track FROM post_labels p GROUP BY 1, 2", SQL_LABELS))
def m1(spark, folder):
    return market.label_frequency(records(spark, folder), LABELS)


@register("m2_label_pairs", record_sql("SELECT a.track, a.label AS label_a, b.label AS label_b, count(*) AS n_posts FROM post_labels a JOIN post_labels b ON a.page_id = b.page_id AND a.label < b.label GROUP BY 1, 2, 3", SQL_LABELS))
def m2(spark, folder):
    return market.label_pairs(records(spark, folder), LABELS)


@register("m3_known_share", record_sql("SELECT track, work_type AS value, count(*) AS n, (SELECT count(*) FROM record r WHERE r.track = p.track AND work_type <> '') AS n_known FROM record p WHERE work_type <> '' GROUP BY 1, 2"))
def m3(spark, folder):
    return market.known_share(records(spark, folder), "work_type")


@register("m4_distribution", record_sql("SELECT track, requirement_level AS value, count(*) AS n FROM record GROUP BY 1, 2"))
def m4(spark, folder):
    return market.distribution(records(spark, folder), "requirement_level")


@register("m5_reconciliation", record_sql("SELECT treatment, track, sum(copies)::BIGINT AS n_raw, count(*) AS n_unique FROM (SELECT track, url_key, arg_min(CASE WHEN work_type = 'Hybrid' THEN 'main' ELSE 'adjacent' END, page_id) AS treatment, count(*) AS copies FROM keys JOIN (SELECT page_id, work_type FROM record) USING (page_id) GROUP BY 1, 2) GROUP BY ROLLUP (treatment, track)", SQL_KEYS))
def m5(spark, folder):
    from attesta.functions.urls import url_key

    treatment = F.when(F.col("work_type") == "Hybrid", "main").otherwise("adjacent")
    return market.reconciliation(records(spark, folder), url_key(F.col("url")), treatment)


@register("j5_post_stream", sql_first_posts("""SELECT track, page_id, CASE track WHEN 'SE Track' THEN 'SE' ELSE 'DA' END || '-' || CASE WHEN k > 999 THEN k::VARCHAR ELSE printf('%03d', k) END AS post_id
FROM (SELECT track, page_id, row_number() OVER (PARTITION BY track ORDER BY n) AS k FROM st WHERE kept)""", "page_id % 3 = 0, page_id"))
def j5(spark, folder):
    """Two deliveries: every third post comes after all others."""
    source, out = folder_for(spark), folder_for(spark)
    rows = records(spark, folder).drop("warnings")
    late = F.pmod("page_id", F.lit(3)) == 0
    write_deliveries([rows.filter(~late), rows.filter(late)], source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    batches.collect_posts(stream, f"{out}/table", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/table").select("track", "page_id", "post_id")
