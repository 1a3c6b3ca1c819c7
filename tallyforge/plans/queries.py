"""Queries over the star-schema tables, one or more per operator, with equivalent SQL.

Doubles in results are moved off rounding ties before they are cut to five places, so that the
order in which an engine adds can't show.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import compression, conformance, features, grammar, graph, integrity, model, probe, ranks
from ..sources import spectra, strict_json
from .base import QUERIES, R5, SQL, query, r5, rounded, table

# --- event grammar and conformance: events of a user's day


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    day = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).cast("int").alias("n_obs"), F.bool_or(F.col("props").isNotNull()).alias("payload"), F.bool_and(F.col("ts").isNotNull()).alias("indexed"),
        F.bool_or(F.col("event_type") == "error").alias("bad"), F.bool_or(F.col("event_type") == "purchase").alias("good"), F.bool_or(F.col("event_type") == "signup").alias("labelled"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("signature"),
    )
    status = F.when(F.col("bad"), "failure").when(F.col("good"), "success").otherwise("unknown")
    none = F.lit(None).cast("string")
    axes = {"operator_id": (F.col("user_id") % 7).cast("string"), "lab_id": F.dayofweek("day").cast("string"), "batch_id": F.floor(F.dayofmonth("day") / 7).cast("string"), "lot_id": F.when(F.col("user_id") % 3 == 0, (F.col("user_id") % 5).cast("string"))}
    return day.select(F.concat_ws("-", F.col("user_id").cast("string"), F.col("day").cast("string")).alias("event_id"), "n_obs", "payload", "indexed", status.alias("status"), (F.col("bad") | F.col("good")).alias("recorded"), "labelled", (F.col("n_obs") % 5 != 0).alias("frozen"), "signature", *[axes.get(a, none).alias(a) for a in grammar.AXES])


DAILY = """
WITH day AS (
  SELECT user_id, ts::DATE AS day, count(*) AS n_obs, bool_or(props IS NOT NULL) AS payload, bool_and(ts IS NOT NULL) AS indexed, bool_or(event_type = 'error') AS bad,
    bool_or(event_type = 'purchase') AS good, bool_or(event_type = 'signup') AS labelled, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS signature
  FROM events GROUP BY ALL
), flat AS (
  SELECT user_id || '-' || day AS event_id, n_obs, payload, indexed, CASE WHEN bad THEN 'failure' WHEN good THEN 'success' ELSE 'unknown' END AS status, bad OR good AS recorded, labelled,
    n_obs % 5 <> 0 AS frozen, signature, (user_id % 7)::VARCHAR AS operator_id, (dayofweek(day) + 1)::VARCHAR AS lab_id, (day(day) // 7)::VARCHAR AS batch_id,
    CASE WHEN user_id % 3 = 0 THEN (user_id % 5)::VARCHAR END AS lot_id FROM day
), l0 AS (
  SELECT count(*) AS event_count, count(*) FILTER (n_obs >= 2) AS multi_obs, median(n_obs)::DOUBLE AS median_obs, count(DISTINCT event_id) = count(*) AS unique_ids,
    count(*) FILTER (payload) / greatest(count(*), 1) AS payload_fraction, coalesce(count(*) FILTER (n_obs >= 2 AND indexed) / nullif(count(*) FILTER (n_obs >= 2), 0), 1.0) AS orderable_fraction FROM flat
), l0p AS (SELECT *, event_count > 0 AND unique_ids AND payload_fraction >= 0.9 AND orderable_fraction >= 0.9 AS passed FROM l0
), cov AS (
  SELECT axis, round(count(v) / greatest(count(*), 1), 3) AS coverage, count(DISTINCT v) AS units FROM (
    SELECT unnest(['operator_id', 'lab_id', 'batch_id', 'lot_id', 'instrument_id', 'instrument_session_id', 'measurement_day', 'run_order']) AS axis,
      unnest([operator_id, lab_id, batch_id, lot_id, NULL, NULL, NULL, NULL]) AS v FROM flat) GROUP BY axis
), l1 AS (
  SELECT count(*) FILTER (coverage >= 0.9) AS logged_axes, coalesce(min(units) FILTER (coverage >= 0.9), 0) AS min_units, count(*) FILTER (coverage >= 0.9) >= 2 AS passed FROM cov
), l2a AS (
  SELECT count(*) FILTER (recorded) / greatest(count(*), 1) AS status_fraction, count(*) FILTER (status IN ('failure', 'ambiguous', 'aborted')) AS negatives, count(*) FILTER (labelled) AS labelled_events,
    count(*) FILTER (labelled AND frozen) / nullif(count(*) FILTER (labelled), 0) AS frozen_fraction FROM flat
), l2 AS (SELECT *, status_fraction >= 0.9 AND negatives >= 1 AND coalesce(frozen_fraction >= 0.9, true) AS passed FROM l2a
), g AS (
  SELECT signature, count(*) AS n, coalesce(min(operator_id) < max(operator_id), false) OR coalesce(min(lab_id) < max(lab_id), false) OR coalesce(min(batch_id) < max(batch_id), false) OR coalesce(min(lot_id) < max(lot_id), false) AS varied
  FROM flat WHERE signature IS NOT NULL GROUP BY signature
), l3a AS (SELECT count(*) AS plan_groups, count(*) FILTER (n >= 2) AS replicated, count(*) FILTER (n >= 2 AND varied) AS varied_groups FROM g
), l3 AS (SELECT *, replicated >= 4 AND varied_groups >= greatest(1, replicated // 2) AS passed FROM l3a)
"""


@query("conformance_level", DAILY + """
SELECT CASE WHEN NOT l0p.passed THEN -1 WHEN NOT l1.passed THEN 0 WHEN NOT l2.passed THEN 1 WHEN NOT l3.passed THEN 2 ELSE 3 END AS level, event_count, logged_axes, min_units, negatives, replicated, varied_groups,
  CASE WHEN round(status_fraction, 3) < 0.9 THEN 'unknown_outcomes_not_recorded' WHEN negatives = 0 THEN 'high_no_negatives_recorded' WHEN negatives < 0.05 * greatest(event_count, 1) THEN 'elevated_few_negatives' ELSE 'low_negatives_present' END AS success_bias_risk,
  CASE WHEN logged_axes = 0 THEN 'none_logged' WHEN min_units BETWEEN 1 AND 4 THEN 'high' ELSE 'lower' END AS few_units_risk
FROM l0p, l1, l2, l3""")
def conformance_level(spark, sf_dir):
    g = conformance.grade(daily_events(spark, sf_dir))
    return g.select("level", F.col("l0_event_count").alias("event_count"), F.col("l1_logged_axes").alias("logged_axes"), F.col("l1_min_units").alias("min_units"), F.col("l2_negatives").alias("negatives"), F.col("l3_replicated").alias("replicated"), F.col("l3_varied_groups").alias("varied_groups"), "success_bias_risk", "few_units_risk")


@query("selection_risk", DAILY + f"""SELECT event_count, {R5('status_fraction')} AS status_fraction, {R5('negatives / event_count')} AS negative_fraction, min_units,
  CASE WHEN round(status_fraction, 3) < 0.9 THEN 'unknown_outcomes_not_recorded' WHEN negatives = 0 THEN 'high_no_negatives_recorded' WHEN negatives < 0.05 * greatest(event_count, 1) THEN 'elevated_few_negatives' ELSE 'low_negatives_present' END AS success_bias_risk,
  CASE WHEN logged_axes = 0 THEN 'none_logged' WHEN min_units BETWEEN 1 AND 4 THEN 'high' ELSE 'lower' END AS few_units_risk FROM l0p, l1, l2""")
def selection_risk(spark, sf_dir):
    g = conformance.grade(daily_events(spark, sf_dir))
    out = g.select(F.col("l0_event_count").alias("event_count"), F.col("l2_status_fraction").alias("status_fraction"), (F.col("l2_negatives") / F.col("l0_event_count")).alias("negative_fraction"), F.col("l1_min_units").alias("min_units"), "success_bias_risk", "few_units_risk")
    return rounded(out, "status_fraction", "negative_fraction")


@query("conformance_l0", DAILY + f"SELECT event_count, multi_obs, median_obs, unique_ids, {R5('payload_fraction')} AS payload_fraction, {R5('orderable_fraction')} AS orderable_fraction, passed FROM l0p")
def conformance_l0(spark, sf_dir):
    return rounded(conformance.level0(daily_events(spark, sf_dir)), "payload_fraction", "orderable_fraction")


@query("conformance_l1", DAILY + "SELECT axis, coverage, units FROM cov")
def conformance_l1(spark, sf_dir):
    return conformance.axis_coverage(daily_events(spark, sf_dir))


@query("conformance_l2", DAILY + f"SELECT {R5('status_fraction')} AS status_fraction, negatives, labelled_events, {R5('frozen_fraction')} AS frozen_fraction, passed FROM l2")
def conformance_l2(spark, sf_dir):
    return rounded(conformance.level2(daily_events(spark, sf_dir)), "status_fraction", "frozen_fraction")


@query("conformance_l3", DAILY + "SELECT * FROM l3")
def conformance_l3(spark, sf_dir):
    return conformance.level3(daily_events(spark, sf_dir))


@query("plan_signature_groups", DAILY + "SELECT signature, n, varied FROM g")
def plan_signature_groups(spark, sf_dir):
    return conformance.plan_groups(daily_events(spark, sf_dir))


@query("grammar_parse_events", """SELECT event_id::VARCHAR AS event_id, coalesce(nullif(event_type, ''), 'unknown') AS system, 1 AS n_obs, event_type IN ('error', 'purchase') AS recorded,
  CASE WHEN event_type = 'error' THEN 'failure' WHEN event_type = 'purchase' THEN 'success' ELSE 'unknown' END AS status, 'kind=' || event_type AS signature, value AS time_s FROM events""")
def grammar_parse_events(spark, sf_dir):
    """Writes each row as a document and reads it back through the strict parser."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "purchase", "success")
    doc = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("event_id"), F.col("event_type").alias("system"), F.struct(F.create_map(F.lit("kind"), F.col("event_type")).alias("planned")).alias("intent"),
        F.array(F.struct(F.col("value").alias("time_s"), F.struct(F.col("props").alias("p")).alias("payload"))).alias("observations"), F.struct(status.alias("status")).alias("outcome"),
    ))
    flat = grammar.parse_events(strict_json.with_document(e.select(doc.alias("value"))))
    return flat.select("event_id", "system", F.size("observations").alias("n_obs"), F.col("outcome.recorded").alias("recorded"), F.col("outcome.status").alias("status"), grammar.plan_signature(F.col("intent.planned"), F.col("intent.plan_id"), F.col("intent.event_group_id")).alias("signature"), F.col("observations")[0]["time_s"].alias("time_s"))


@query("strict_json_rejects", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'plain' WHEN 1 THEN 'repeated_key' WHEN 2 THEN 'nan' ELSE 'huge' END AS form, event_id % 4 = 0 AND json_valid(props) AS ok FROM events""")
def strict_json_rejects(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit('{"a":1,"a":'), F.col("event_id").cast("string"), F.lit("}"))).when(kind == 2, F.lit('{"a":NaN}')).otherwise(F.lit('{"a":[1e999]}'))
    form = F.when(kind == 0, "plain").when(kind == 1, "repeated_key").when(kind == 2, "nan").otherwise("huge")
    return strict_json.with_document(e.select("event_id", form.alias("form"), text.alias("value"))).select("event_id", "form", "ok")


@query("typed_fields", """SELECT event_id, (props->>'$.k')::DOUBLE AS k, NULL::DOUBLE AS flag_as_number, (event_id % 2 = 0) AS flag FROM events""")
def typed_fields(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("value", F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "flag": '), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit("}")))
    d = strict_json.with_document(e)
    return d.select("event_id", strict_json.field("doc", "$.k", "double").alias("k"), strict_json.field("doc", "$.flag", "double").alias("flag_as_number"), strict_json.field("doc", "$.flag", "boolean").alias("flag"))


@query("content_hash_ledger", "SELECT doc_id, strlen(text)::BIGINT AS bytes, sha256(text) AS sha256 FROM documents")
def content_hash_ledger(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))


@query("strict_json_sink", """SELECT '{"a":' || event_id || ',"b":null}' AS value FROM events""")
def strict_json_sink(spark, sf_dir):
    return strict_json.to_strict_json(table(spark, sf_dir, "events").select(F.col("event_id").alias("a"), F.lit(float("nan")).alias("b")))


@query("safe_paths", """SELECT event_id, event_id % 5 = 0 AS safe FROM events""")
def safe_paths(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    forms = F.array(*[F.lit(x) for x in ("tables/a.json", "../a.json", "/etc/a.json", "", "a\\..\\b.json")])
    return e.select("event_id", strict_json.safe_path(F.get(forms, F.col("event_id") % 5)).alias("safe"))


@query("header_parse", """SELECT page_id, url AS source, 1 AS n_points, page_id::DOUBLE AS x, length(html)::DOUBLE AS y FROM pages""")
def header_parse(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    text = F.concat(F.lit("##SOURCE="), F.col("url"), F.lit("\n##KIND=page\n"), F.col("page_id").cast("string"), F.lit(", "), F.length("html").cast("string"), F.lit("\nnot a row, at all\n"))
    s = p.select("page_id", spectra.parse_spectrum(text).alias("s"))
    return s.select("page_id", F.col("s.header")["SOURCE"].alias("source"), F.size("s.points").alias("n_points"), F.col("s.points")[0]["x"].alias("x"), F.col("s.points")[0]["y"].alias("y"))


@query("spread_sample", """WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT doc_id FROM n WHERE i IN (SELECT k * (n.n - 1) // 49 FROM range(50) t(k), (SELECT any_value(n) AS n FROM n) n)""")
def spread_sample(spark, sf_dir):
    return spectra.spread_sample(table(spark, sf_dir, "documents").select("doc_id"), 50, "spread", "doc_id")


# --- filters and parsing


@query("bounds_flag", """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity BETWEEN 1 AND 40 AND l_discount BETWEEN 0.01 AND 0.09 AS inside,
  concat_ws(',', CASE WHEN NOT l_quantity BETWEEN 1 AND 40 THEN 'quantity' END, CASE WHEN NOT l_discount BETWEEN 0.01 AND 0.09 THEN 'discount' END) AS note FROM lineitem""")
def bounds_flag(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    q, d = sc.in_bounds(F.col("l_quantity"), 1, 40), sc.in_bounds(F.col("l_discount"), 0.01, 0.09)
    return l.select("l_orderkey", "l_linenumber", "l_partkey", (q & d).alias("inside"), F.concat_ws(",", F.when(~q, "quantity"), F.when(~d, "discount")).alias("note"))


@query("min_group_filter", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 60")
def min_group_filter(spark, sf_dir):
    return features.groups_of_at_least(table(spark, sf_dir, "events"), ["user_id"], 60).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("paired_filter", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_returnflag) >= 3")
def paired_filter(spark, sf_dir):
    return features.groups_with_several(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_returnflag", 3).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))


@query("label_token_counts", "SELECT token, count(*) AS n FROM (SELECT 'int:' || quality AS token FROM labels UNION ALL SELECT 'str:' || event_type FROM events) GROUP BY token")
def label_token_counts(spark, sf_dir):
    a = table(spark, sf_dir, "labels").select(sc.label_token("int", F.col("quality")).alias("token"))
    return a.unionByName(table(spark, sf_dir, "events").select(sc.label_token("str", F.col("event_type")).alias("token"))).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("policy_regex_parse", "SELECT p_partkey, (p_size || '.5')::DOUBLE AS a, (p_partkey % 100)::DOUBLE AS b, p_size::DOUBLE AS c, NULL::DOUBLE AS none FROM part")
def policy_regex_parse(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.concat_ws("", F.col("p_size").cast("string"), F.lit("_5C("), (F.col("p_partkey") % 100).cast("string"), F.lit("PER)_"), F.col("p_size").cast("string"), F.lit("C"))
    a, b, c = sc.policy_numbers(text, r"^([0-9_]+)C\((\d+)PER\)_([0-9]+)C$")
    return p.select("p_partkey", a.alias("a"), b.alias("b"), c.alias("c"), sc.policy_numbers(F.col("p_name"), r"^([0-9_]+)C", 1)[0].alias("none"))


@query("elapsed_compare", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE sign(value * 60 - 1800)::INT END AS cmp FROM events")
def elapsed_compare(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    origin = F.when(F.col("event_id") % 3 == 0, "other").otherwise("start")
    return e.select("event_id", sc.compare_elapsed(F.col("value"), F.lit("minutes"), origin, F.lit(1800.0), F.lit("seconds"), F.lit("start")).alias("cmp"))


@query("offset_timestamps", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN epoch(date_trunc('second', ts))::BIGINT END AS at FROM events")
def offset_timestamps(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "+00:00").otherwise(""))
    return e.select("event_id", F.unix_timestamp(sc.offset_timestamp(text)).alias("at"))


# --- integrity


@query("fk_missing_reference", """SELECT 'unknown_reference' AS code, 'orders' AS row_type, o_orderkey::VARCHAR AS row_id, 'o_custkey=' || o_custkey AS detail FROM orders WHERE o_custkey NOT IN (SELECT CASE WHEN c_nationkey = 3 THEN -c_custkey ELSE c_custkey END FROM customer)
UNION ALL SELECT DISTINCT 'unknown_reference', 'lineitem', l_orderkey::VARCHAR, 'l_suppkey=' || l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT CASE WHEN s_nationkey = 5 THEN -s_suppkey ELSE s_suppkey END FROM supplier)""")
def fk_missing_reference(spark, sf_dir):
    t = {"orders": table(spark, sf_dir, "orders"), "lineitem": table(spark, sf_dir, "lineitem"), "customer": table(spark, sf_dir, "customer").withColumn("c_custkey", F.expr("CASE WHEN c_nationkey = 3 THEN -c_custkey ELSE c_custkey END")), "supplier": table(spark, sf_dir, "supplier").withColumn("s_suppkey", F.expr("CASE WHEN s_nationkey = 5 THEN -s_suppkey ELSE s_suppkey END"))}
    a = integrity.missing_references(t, integrity.Reference("orders", "o_custkey", "customer", "c_custkey"), "o_orderkey")
    return a.unionByName(integrity.missing_references(t, integrity.Reference("lineitem", "l_suppkey", "supplier", "s_suppkey"), "l_orderkey"))


@query("duplicate_row_id", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_row_id(spark, sf_dir):
    return integrity.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("first_row_wins", "SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL")
def first_row_wins(spark, sf_dir):
    return integrity.first_rows(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"], ["l_partkey"])


@query("full_outer_reconcile", """SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' WHEN a.v = b.v THEN 'same' ELSE 'differs' END AS state
FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN -o_orderkey ELSE o_orderkey END AS k, CASE o_orderstatus WHEN 'F' THEN 'F' ELSE 'O' END AS v FROM orders) a
FULL JOIN (SELECT CASE WHEN l_orderkey % 5 = 0 THEN -1 - l_orderkey ELSE l_orderkey END AS k, max(l_linestatus) AS v FROM lineitem GROUP BY 1) b ON a.k = b.k""")
def full_outer_reconcile(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.expr("CASE WHEN o_orderkey % 3 = 0 THEN -o_orderkey ELSE o_orderkey END").alias("k"), F.when(F.col("o_orderstatus") == "F", "F").otherwise("O").alias("v"))
    b = table(spark, sf_dir, "lineitem").groupBy(F.expr("CASE WHEN l_orderkey % 5 = 0 THEN -1 - l_orderkey ELSE l_orderkey END").alias("k")).agg(F.max("l_linestatus").alias("v"))
    return integrity.reconcile(a, b, "k", "v", "v")


@query("cross_completeness", """SELECT s AS c_mktsegment, n AS c_nationkey FROM (SELECT DISTINCT c_mktsegment AS s FROM customer), (SELECT DISTINCT c_nationkey AS n FROM customer)
EXCEPT SELECT c_mktsegment, CASE WHEN c_acctbal > 9500 THEN c_nationkey END FROM customer""")
def cross_completeness(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return integrity.missing_combinations(c.withColumn("c_nationkey", F.expr("CASE WHEN c_acctbal > 9500 THEN c_nationkey END")), c.select("c_mktsegment"), c.select("c_nationkey"))


@query("state_clock_violations", """SELECT 'shipped_before_ordered' AS code, 'line' AS row_type, id AS row_id, CAST(shipped AS VARCHAR) || ' < ' || CAST(ordered AS VARCHAR) AS detail FROM (
  SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey AS id, l_shipdate::DATE AS shipped, o_orderdate::DATE AS ordered FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE shipped < ordered""")
def state_clock_violations(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    m = m.select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("id"), F.to_date("o_orderdate").alias("ordered"), F.to_date("l_shipdate").alias("shipped"))
    return integrity.ordered_clocks(m, "line", "id", ["ordered", "shipped"])


@query("outcome_semantics", """SELECT code, 'outcome' AS row_type, id AS row_id, status AS detail FROM (SELECT id, status, CASE WHEN status = 'exact' AND v IS NULL THEN 'exact_without_value' WHEN status = 'right_censored' AND lo IS NULL THEN 'censored_without_bound'
  WHEN status = 'right_censored' AND v IS NOT NULL THEN 'censored_with_value' WHEN status = 'none' AND (v IS NOT NULL OR lo IS NOT NULL) THEN 'missing_with_value' WHEN status = 'exact' AND lo IS NOT NULL THEN 'exact_with_bounds' END AS code
  FROM (SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey AS id, CASE l_returnflag WHEN 'A' THEN 'exact' WHEN 'R' THEN 'right_censored' ELSE 'none' END AS status, CASE WHEN l_quantity > 10 THEN l_quantity END AS v, CASE WHEN l_discount > 0.05 THEN l_discount END AS lo FROM lineitem)) WHERE code IS NOT NULL""")
def outcome_semantics(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    rows = l.select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("id"), F.when(F.col("l_returnflag") == "A", "exact").when(F.col("l_returnflag") == "R", "right_censored").otherwise("none").alias("s"), F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("v"), F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("lo"), F.lit(None).cast("double").alias("hi"))
    return integrity.outcome_rules(rows, "id", "s", "v", "lo", "hi")


@query("partition_leakage", "SELECT l_partkey, count(DISTINCT l_orderkey % 3) AS n_partitions FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey % 3) > 1")
def partition_leakage(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("part", F.col("l_orderkey") % 3)
    return integrity.partition_leaks(l, "l_partkey", "part")


@query("edge_parent_mismatch", """SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, o_custkey % 4 AS src_part, o_orderkey % 4 AS dst_part FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey % 4 <> o_orderkey % 4""")
def edge_parent_mismatch(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    nodes = o.select(name("o", "o_orderkey").alias("node"), (F.col("o_orderkey") % 4).alias("part")).unionByName(c.select(name("c", "c_custkey").alias("node"), (F.col("c_custkey") % 4).alias("part")))
    return integrity.edges_across(o.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst")), nodes, "part")


def lineage(spark, sf_dir):
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    return n.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst")).unionByName(c.select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst")))


LINEAGE = "edges AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"


@query("lineage_closure", f"WITH RECURSIVE {LINEAGE}, walk AS (SELECT src, dst FROM edges UNION SELECT walk.src, edges.dst FROM walk JOIN edges ON walk.dst = edges.src) SELECT DISTINCT src, dst FROM walk")
def lineage_closure(spark, sf_dir):
    return graph.closure(lineage(spark, sf_dir))


@query("lineage_acyclic", "SELECT 'n' || n_nationkey AS node FROM nation WHERE n_regionkey = 2 UNION SELECT 'r2' UNION SELECT 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def lineage_acyclic(spark, sf_dir):
    """The first nation of region 2 is made to lead back to it: the cycle and all below is left."""
    back = table(spark, sf_dir, "nation").where("n_regionkey = 2").agg(F.concat(F.lit("n"), F.min("n_nationkey").cast("string")).alias("src")).withColumn("dst", F.lit("r2"))
    return graph.cyclic_residue(lineage(spark, sf_dir).unionByName(back))


@query("several_producers", "SELECT l_partkey::VARCHAR AS dst, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def several_producers(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("src"), F.col("l_partkey").cast("string").alias("dst"))
    return graph.several_producers(l)


@query("freeze_before_access", """SELECT DISTINCT 'f' || n_nationkey AS rep_id, o_orderkey AS outcome_id, DATE '1996-06-01' AS frozen_at, o_orderdate::DATE AS accessible_at FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE DATE '1996-06-01' >= o_orderdate::DATE""")
def freeze_before_access(spark, sf_dir):
    n, o = table(spark, sf_dir, "nation"), table(spark, sf_dir, "orders")
    frozen = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("rep_id"), F.lit("1996-06-01").cast("date").alias("frozen_at"))
    outcomes = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node"), F.col("o_orderkey").alias("outcome_id"), F.to_date("o_orderdate").alias("accessible_at"))
    return integrity.freeze_before_access(frozen, outcomes, lineage(spark, sf_dir))


@query("denominator_reconcile", """SELECT unnest(['orders', 'open', 'customers', 'declared_wrong']) AS name, unnest([count(*), count(*) FILTER (o_orderstatus = 'O'), count(DISTINCT o_custkey), count(*)]) AS actual,
  unnest([NULL, NULL, NULL, -1]::BIGINT[]) AS declared, unnest([true, true, true, false]) AS ok FROM orders""")
def denominator_reconcile(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return integrity.denominators(o, {"orders": F.count(F.lit(1)), "open": F.count_if(F.col("o_orderstatus") == "O"), "customers": F.countDistinct("o_custkey"), "declared_wrong": F.count(F.lit(1))}, {"declared_wrong": -1})


@query("bridge_crossing", """WITH x AS (SELECT c_mktsegment AS c, c_nationkey AS e, count(DISTINCT c_custkey) AS u FROM customer GROUP BY ALL)
SELECT c AS condition, count(*) AS environments, sum(u)::BIGINT AS units, count(*) = (SELECT count(DISTINCT c_nationkey) FROM customer) AND min(u) >= 2 AS crossed FROM x GROUP BY c""")
def bridge_crossing(spark, sf_dir):
    return integrity.bridge_crossing(table(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey", "c_custkey", 2)


# --- compression audit: two fixed predictors of a line's price


def arms(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    y = F.col("l_extendedprice") / 1000
    return l.select(
        F.col("l_orderkey").alias("row_id"), (F.col("l_linenumber") <= 6).alias("universe"), (F.col("l_quantity") > 2).alias("compact"), (F.col("l_discount") < 0.1).alias("reference"),
        F.col("l_quantity").alias("importance"), (F.lit(1.0) + F.col("l_linenumber")).alias("weight"), sc.absolute_error(y, F.lit(50.0)).alias("compact_loss"), sc.absolute_error(y, F.col("l_quantity") * 2).alias("reference_loss"),
        F.col("l_suppkey").alias("cluster"), F.col("l_returnflag").alias("environment"),
    )


ARMS = """WITH a AS (SELECT l_orderkey AS row_id, l_linenumber <= 6 AS u, l_quantity > 2 AS c, l_discount < 0.1 AS r, l_quantity AS imp, 1.0::DOUBLE + l_linenumber AS w, abs(l_extendedprice / 1000 - 50) AS cl, abs(l_extendedprice / 1000 - l_quantity * 2) AS rl, l_suppkey AS cluster, l_returnflag AS environment FROM lineitem)"""
_SUPPORT = ["support_loss", "weighted_support_loss", "reference_support_loss", "excluded_of_reference", "excluded_weight_of_reference"]
_SUPPORT_SQL = f"""count(*) FILTER (u) AS universe_count, count(*) FILTER (u AND c) AS compact_count, count(*) FILTER (u AND r) AS reference_count, count(*) FILTER (u AND r AND NOT c) AS excluded_count,
  {R5('count(*) FILTER (u AND NOT c) / count(*) FILTER (u)')} AS support_loss, {R5('sum(imp) FILTER (u AND NOT c) / sum(imp) FILTER (u)')} AS weighted_support_loss, {R5('count(*) FILTER (u AND NOT r) / count(*) FILTER (u)')} AS reference_support_loss,
  {R5('count(*) FILTER (u AND r AND NOT c) / count(*) FILTER (u AND r)')} AS excluded_of_reference, {R5('sum(imp) FILTER (u AND r AND NOT c) / sum(imp) FILTER (u AND r)')} AS excluded_weight_of_reference,
  CASE WHEN count(*) FILTER (u AND NOT c) / count(*) FILTER (u) > 0.05 OR sum(imp) FILTER (u AND NOT c) / sum(imp) FILTER (u) > 0.05 THEN 'support_loss' ELSE 'within_support_tolerances' END AS support_verdict"""


@query("support_loss", f"{ARMS} SELECT {_SUPPORT_SQL} FROM a")
def support_loss(spark, sf_dir):
    return rounded(compression.support(arms(spark, sf_dir)), *_SUPPORT)


@query("env_support", f"{ARMS} SELECT environment, {_SUPPORT_SQL} FROM a GROUP BY environment")
def env_support(spark, sf_dir):
    return rounded(compression.support(arms(spark, sf_dir), ["environment"]), *_SUPPORT)


def _risk_sql(root: bool = False) -> str:
    s = "sqrt" if root else ""
    c, r = (f"{s}(sum(w * {x}) / sum(w))" for x in ("cl", "rl"))
    return f"count(*) AS common_count, {R5(c)} AS compact_risk, {R5(r)} AS reference_risk, {R5(f'{c} - {r}')} AS risk_gap"


@query("common_risk", f"{ARMS} SELECT {_risk_sql()} FROM a WHERE u AND c AND r")
def common_risk(spark, sf_dir):
    return rounded(compression.common_risk(arms(spark, sf_dir)), "compact_risk", "reference_risk", "risk_gap")


@query("env_risk", f"{ARMS} SELECT environment, {_risk_sql(True)} FROM a WHERE u AND c AND r GROUP BY environment")
def env_risk(spark, sf_dir):
    return rounded(compression.common_risk(arms(spark, sf_dir), ["environment"], root=True), "compact_risk", "reference_risk", "risk_gap")


@query("cluster_sums", f"{ARMS} SELECT cluster, min(row_id) AS first, count(*) AS n, {R5('sum(w)')} AS w, {R5('sum(w * cl)')} AS wc, {R5('sum(w * rl)')} AS wr FROM a WHERE u AND c AND r GROUP BY cluster")
def cluster_sums(spark, sf_dir):
    return rounded(compression.cluster_sums(arms(spark, sf_dir)), "w", "wc", "wr")


@query("cluster_bootstrap_ci")
def cluster_bootstrap_ci(spark, sf_dir):
    return compression.bootstrap_interval(arms(spark, sf_dir))


@query("compression_audit")
def compression_audit(spark, sf_dir):
    return compression.audit_pair(arms(spark, sf_dir))


@query("losses_all", f"""SELECT l_orderkey, l_linenumber, l_partkey, {R5('pow(l_discount - l_tax, 2)')} AS squared, {R5('abs(l_discount - l_tax)')} AS absolute,
  {R5("pow((l_returnflag = 'R')::INT - (0.05 + l_discount), 2)")} AS brier, {R5("-log2(CASE WHEN l_returnflag = 'R' THEN 0.05 + l_discount ELSE 1 - (0.05 + l_discount) END)")} AS bits FROM lineitem""")
def losses_all(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    y, p = (F.col("l_returnflag") == "R").cast("int"), F.lit(0.05) + F.col("l_discount")
    return rounded(l.select("l_orderkey", "l_linenumber", "l_partkey", sc.squared_error(F.col("l_discount"), F.col("l_tax")).alias("squared"), sc.absolute_error(F.col("l_discount"), F.col("l_tax")).alias("absolute"), sc.brier(y, p).alias("brier"), sc.log_loss_bits(y, p).alias("bits")), "squared", "absolute", "brier", "bits")


@query("information_cutoff", """SELECT count(*) FILTER (s > 40) AS state_violations, count(*) FILTER (a > 60) AS deadline_violations, count(*) FILTER (a < s) AS order_violations, count(*) FILTER (s > 40 OR a > 60 OR a < s) AS violations,
  count(*) FILTER (s IS NULL) AS unknown_times, 'violated' AS verdict FROM (SELECT CASE WHEN event_id % 50 <> 0 THEN value END AS s, value + (event_id % 7) - 1 AS a FROM events)""")
def information_cutoff(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 50 != 0, F.col("value")).alias("s"), (F.col("value") + F.col("event_id") % 7 - 1).alias("a"))
    return compression.information_cutoff(e, "s", 40.0, "a", 60.0)


@query("pair_collisions", f"""WITH rep AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 <> 0 THEN floor(o_totalprice / 50000)::BIGINT END AS token FROM orders), p AS (
  SELECT o_orderkey AS l, o_orderkey + 1 AS r, 1.0::DOUBLE + o_orderkey % 3 AS w FROM orders), m AS (SELECT w, a.token AS lt, b.token AS rt FROM p LEFT JOIN rep a ON a.id = l LEFT JOIN rep b ON b.id = r), s AS (
  SELECT count(*) AS pairs, count(*) FILTER (lt IS NOT NULL AND rt IS NOT NULL) AS covered, count(*) FILTER (lt = rt) AS collisions, sum(w) FILTER (lt IS NOT NULL AND rt IS NOT NULL) AS cw, sum(w) FILTER (lt = rt) AS hw FROM m)
SELECT pairs, covered, collisions, {R5('collisions / covered')} AS collision_rate, {R5('hw / cw')} AS weighted_rate, {R5('1 - collisions / covered / 2')} AS ceiling, {R5('1 - hw / cw / 2')} AS weighted_ceiling, 'collision_loss' AS verdict FROM s""")
def pair_collisions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rep = o.select(F.col("o_orderkey").alias("row_id"), F.when(F.col("o_orderkey") % 11 != 0, F.floor(F.col("o_totalprice") / 50000)).alias("token"))
    pairs = o.select(F.col("o_orderkey").alias("left_id"), (F.col("o_orderkey") + 1).alias("right_id"), (F.lit(1.0) + F.col("o_orderkey") % 3).alias("weight"))
    return rounded(compression.pair_collisions(rep, pairs), "collision_rate", "weighted_rate", "ceiling", "weighted_ceiling")


# --- features, pairs, ranks


def cells(spark, sf_dir):
    """Orders of a customer as cells with exact or censored lives."""
    o = table(spark, sf_dir, "orders")
    days = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date"))
    return o.select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "P", days).alias("life"), F.when(F.col("o_orderstatus") == "P", days).alias("low"), (F.floor(F.col("o_totalprice") / 10000)).alias("score"))


CELLS = """WITH x AS (SELECT o_custkey AS g, o_orderkey AS pos, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE - DATE '1995-01-01' END AS life, CASE WHEN o_orderstatus = 'P' THEN o_orderdate::DATE - DATE '1995-01-01' END AS low, floor(o_totalprice / 10000)::BIGINT AS score FROM orders), p AS (
  SELECT a.g, a.pos AS lpos, b.pos AS rpos, a.life AS ll, b.life AS rl, a.score AS ls, b.score AS rs, CASE WHEN a.life IS NOT NULL AND b.life IS NOT NULL THEN CASE WHEN a.life = b.life THEN 'tied' ELSE 'exact' END WHEN a.life IS NOT NULL AND b.low > a.life THEN 'censor_resolved' WHEN b.life IS NOT NULL AND a.low > b.life THEN 'censor_resolved' ELSE 'unresolvable' END AS kind
  FROM x a JOIN x b ON a.g = b.g AND a.pos < b.pos), q AS (SELECT *, CASE WHEN kind = 'exact' THEN CASE WHEN ll > rl THEN lpos ELSE rpos END WHEN kind = 'censor_resolved' THEN CASE WHEN ll IS NOT NULL THEN rpos ELSE lpos END END AS winner FROM p)"""


@query("ranking_pairs", CELLS + " SELECT g AS o_custkey, lpos, rpos, kind, winner FROM q")
def ranking_pairs(spark, sf_dir):
    return features.ranking_pairs(cells(spark, sf_dir), "o_custkey", "o_orderkey", "life", "low")


@query("pair_counts", CELLS + " SELECT kind, count(*) AS n FROM q GROUP BY kind")
def pair_counts(spark, sf_dir):
    counts = ranks.pair_counts(cells(spark, sf_dir), ["o_custkey"], "life", "low")
    return counts.groupBy("kind").agg(F.sum("n").alias("n"))


@query("pair_accuracy_by_group", CELLS + f" SELECT kind, count(*) AS n, {R5('avg(CASE WHEN ls = rs THEN 0.5 WHEN (ls > rs) = (winner = lpos) THEN 1 ELSE 0 END)')} AS accuracy FROM q WHERE winner IS NOT NULL GROUP BY kind")
def pair_accuracy_by_group(spark, sf_dir):
    counts = ranks.pair_counts(cells(spark, sf_dir), ["o_custkey"], "life", "low", "score").where("correct is not null")
    return rounded(counts.groupBy("kind").agg(F.sum("n").alias("n"), (F.sum("correct") / F.sum("n")).alias("accuracy")), "accuracy")


def series(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day")).agg(F.sum((F.col("value") * 100).cast("long")).alias("cents")).withColumn("value", F.col("cents").cast("double"))


SERIES = "s AS (SELECT user_id, ts::DATE - DATE '2024-01-01' AS day, sum(trunc(value * 100)::BIGINT)::DOUBLE AS value FROM events GROUP BY ALL)"
GRID = f"""WITH {SERIES}, ok AS (SELECT user_id FROM s WHERE day BETWEEN 0 AND 20 GROUP BY 1 HAVING min(day) = 0 AND max(day) = 20), n AS (
  SELECT user_id, day, value, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS d2, lead(value) OVER (PARTITION BY user_id ORDER BY day) AS v2 FROM s WHERE day BETWEEN 0 AND 20 AND user_id IN (SELECT user_id FROM ok)), grid AS (
  SELECT user_id, g AS day, CASE WHEN g > day THEN value + (g - day) / (d2 - day) * (v2 - value) ELSE value END AS value, g > day AS filled FROM (SELECT *, unnest(range(day, coalesce(d2, day + 1))) AS g FROM n))"""


@query("grid_interpolation", f"{GRID} SELECT user_id, day::INT AS day, {R5('value')} AS value, filled FROM grid")
def grid_interpolation(spark, sf_dir):
    return rounded(features.fixed_grid(series(spark, sf_dir), "user_id", "day", "value", 0, 20), "value")


@query("seven_number_summary", f"""{GRID}, d AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY day) AS step FROM grid)
SELECT user_id, {R5('min_by(value, day)')} AS first, {R5('max_by(value, day)')} AS last, {R5('avg(value)')} AS mean, {R5('max(value)')} AS greatest, {R5('min(value)')} AS least, {R5('regr_slope(value, day)')} AS slope, {R5('log10(var_pop(step) + 1e-12)')} AS roughness FROM d GROUP BY user_id""")
def seven_number_summary(spark, sf_dir):
    g = features.fixed_grid(series(spark, sf_dir), "user_id", "day", "value", 0, 20)
    return rounded(features.seven_numbers(g, "user_id", "day", "value"), "first", "last", "mean", "greatest", "least", "slope", "roughness")


@query("last_and_half_slope", f"""WITH {SERIES}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM s)
SELECT user_id, count(*) AS n, max_by(value, day) AS last, {R5('coalesce(regr_slope(value, day) FILTER (k < n // 2), 0)')} AS head_slope, {R5('coalesce(regr_slope(value, day) FILTER (k >= n // 2), 0)')} AS tail_slope FROM r GROUP BY user_id""")
def last_and_half_slope(spark, sf_dir):
    return rounded(features.half_slopes(series(spark, sf_dir), "user_id", "day", "value"), "head_slope", "tail_slope")


@query("local_peak_density", f"""WITH {SERIES}, n AS (SELECT user_id, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM s WINDOW w AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, count(*) AS interior, count(*) FILTER (value > a AND value >= b AND value > 5000) AS peaks FROM n WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY user_id""")
def local_peak_density(spark, sf_dir):
    return features.local_peaks(series(spark, sf_dir), "user_id", "day", "value", 5000.0)


@query("vector_derivative", f"SELECT vec_id, {R5('embedding[2]::DOUBLE - embedding[1]::DOUBLE')} AS d0, {R5('embedding[64]::DOUBLE - embedding[63]::DOUBLE')} AS d62, len(embedding) - 1 AS n FROM embeddings")
def vector_derivative(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", sc.differences(F.col("embedding").cast("array<double>")).alias("d"))
    return rounded(e.select("vec_id", F.col("d")[0].alias("d0"), F.col("d")[62].alias("d62"), F.size("d").alias("n")), "d0", "d62")


@query("spectrum_summary_quantiles", f"""SELECT label, count(*) AS n, {R5('avg(x)')} AS mean, {R5('stddev_pop(x)')} AS deviation, {R5('max(x)')} AS greatest, count(*) FILTER (x > 0.05) AS above_0, count(*) FILTER (x > 0.1) AS above_1, count(*) FILTER (x > 0.2) AS above_2,
  {', '.join(R5(f'quantile_cont(x, {q})') + f' AS q{int(q * 100):02d}' for q in (0.05, 0.25, 0.5, 0.75, 0.95))} FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label""")
def spectrum_summary_quantiles(spark, sf_dir):
    out = features.element_summary(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return rounded(out, "mean", "deviation", "greatest", *[c for c in out.columns if c[0] == "q"])


@query("row_zscore_l1", f"""WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings), m AS (SELECT vec_id, e, list_avg(e) AS mu, sqrt(list_avg(list_transform(e, lambda v: v * v)) - pow(list_avg(e), 2)) AS sd, list_sum(list_transform(e, lambda v: abs(v))) AS l1 FROM x)
SELECT vec_id, {R5('(e[1] - mu) / (sd + 1e-6)')} AS z0, {R5('(e[64] - mu) / (sd + 1e-6)')} AS z63, {R5('e[1] / (l1 + 1e-6)')} AS n0 FROM m""")
def row_zscore_l1(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    z = e.select("vec_id", sc.zscores(F.col("e")).alias("z"), sc.l1_normalized(F.col("e")).alias("l"))
    return rounded(z.select("vec_id", F.col("z")[0].alias("z0"), F.col("z")[63].alias("z63"), F.col("l")[0].alias("n0")), "z0", "z63", "n0")


@query("worst_topk", """SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_extendedprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 5""")
def worst_topk(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("pos", F.struct("l_orderkey", "l_linenumber", "l_partkey"))
    return features.worst_rows(l, ["l_returnflag"], "l_extendedprice", "pos").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "rank")


@query("spearman_by_group", f"""WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS a, rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2 AS b FROM events)
SELECT event_type, count(*) AS n, {R5('corr(a, b)')} AS rho FROM r GROUP BY event_type""")
def spearman_by_group(spark, sf_dir):
    return rounded(features.spearman(table(spark, sf_dir, "events"), "event_type", "value", "user_id"), "rho")


@query("macro_weights", f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN {R5("1 / count(*) FILTER (o_orderstatus = 'F') OVER (PARTITION BY o_orderpriority)")} ELSE 0.0::DOUBLE END AS macro_weight FROM orders""")
def macro_weights(spark, sf_dir):
    out = features.macro_weights(table(spark, sf_dir, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F")
    return rounded(out.select("o_orderkey", "macro_weight"), "macro_weight")


@query("macro_mae", f"SELECT count(*) AS groups, {R5('avg(m)')} AS macro_mae FROM (SELECT avg(abs(o_totalprice / 1000 - 200)) AS m FROM orders GROUP BY o_custkey)")
def macro_mae(spark, sf_dir):
    return rounded(features.macro_mae(table(spark, sf_dir, "orders").withColumn("e", F.col("o_totalprice") / 1000 - 200), "o_custkey", "e"), "macro_mae")


@query("continuation_merge", """WITH RECURSIVE b AS (SELECT conv_id // 3 AS k, conv_id % 3 AS part, turn, role FROM conversations), p AS (SELECT k, part, min(turn) AS lo, max(turn) AS hi, row_number() OVER (PARTITION BY k ORDER BY part) AS i FROM b GROUP BY k, part), w AS (
  SELECT k, part, i, CASE WHEN lo > 0 THEN 0 ELSE 0 END::BIGINT AS shift, greatest(0, hi)::BIGINT AS top FROM p WHERE i = 1 UNION ALL
  SELECT p.k, p.part, p.i, CASE WHEN p.lo > w.top THEN 0 ELSE w.top END, greatest(w.top, p.hi + CASE WHEN p.lo > w.top THEN 0 ELSE w.top END) FROM w JOIN p ON p.k = w.k AND p.i = w.i + 1)
SELECT b.k, b.part, turn, turn + shift AS merged FROM b JOIN w ON b.k = w.k AND b.part = w.part""")
def continuation_merge(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.floor(F.col("conv_id") / 3).alias("k"), (F.col("conv_id") % 3).alias("part"), "turn")
    return features.continued_positions(c, "k", "part", "turn").select("k", "part", "turn", "merged")


@query("counterbalanced_design", """SELECT *, row_number() OVER (PARTITION BY session ORDER BY md5(condition || '|' || replicate)) AS run_order FROM (SELECT c AS condition, r AS replicate, (c + r) % 3 AS session, (c + c // 2 + r) % 2 AS operator, (c + r * 3) % 4 AS lot FROM range(16) a(c), range(3) b(r))""")
def counterbalanced_design(spark, sf_dir):
    return features.counterbalanced_design(spark)


@query("first_crossing", "SELECT user_id, min(day) FILTER (value <= 2000)::INT AS first_low, min(value) AS least FROM (SELECT user_id, ts::DATE - DATE '2024-01-01' AS day, sum(trunc(value * 100)::BIGINT)::DOUBLE AS value FROM events GROUP BY ALL) GROUP BY user_id")
def first_crossing(spark, sf_dir):
    return series(spark, sf_dir).groupBy("user_id").agg(F.min(F.when(F.col("value") <= 2000, F.col("day"))).alias("first_low"), F.min("value").alias("least"))


_SHOWN = """CASE o_orderkey % 6 WHEN 0 THEN 'about ' || round(v, 2) WHEN 1 THEN 'about ' || round(v + 3, 2) WHEN 2 THEN 'in 1997 it was ' || round(v, 1)
  WHEN 3 THEN 'from ' || round(w, 2) || ' to ' || round(v, 2) WHEN 4 THEN round(v, 2) || '-' || round(w, 2) ELSE 'unknown' END"""


@query("ledger_display_match", f"""WITH x AS (SELECT o_orderkey, o_totalprice / 7 AS v, -o_totalprice / 9 AS w FROM orders), y AS (SELECT *, {_SHOWN} AS shown FROM x),
z AS (SELECT *, CASE WHEN o_orderkey % 6 IN (3, 4) THEN [w, v] ELSE [v] END AS vals,
  list_transform(regexp_extract_all(shown, '-?[0-9]+[.]?[0-9]*'), lambda t: {{'n': t::DOUBLE, 'p': CASE WHEN contains(t, '.') THEN length(split_part(t, '.', 2)) ELSE 0 END}}) AS ns FROM y)
SELECT o_orderkey, len(ns) = len(vals) AND len(list_filter(list_zip(vals, ns), lambda q: round(q[1], (q[2]).p::INT) <> (q[2]).n)) = 0 AS ok FROM z""")
def ledger_display_match(spark, sf_dir):
    """One number shown rightly, wrongly or beside a year; two in the right and in the wrong order; none."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 7).alias("v"), (-F.col("o_totalprice") / 9).alias("w"))
    k, text = F.col("o_orderkey") % 6, lambda c, n: F.format_string(f"%.{n}f", F.round(c, n))
    v, w = text(F.col("v"), 2), text(F.col("w"), 2)
    shown = F.when(k == 0, F.concat(F.lit("about "), v)).when(k == 1, F.concat(F.lit("about "), text(F.col("v") + 3, 2))).when(k == 2, F.concat(F.lit("in 1997 it was "), text(F.col("v"), 1)))
    shown = shown.when(k == 3, F.concat(F.lit("from "), w, F.lit(" to "), v)).when(k == 4, F.concat(v, F.lit("-"), w)).otherwise("unknown")
    values = F.when(k.isin(3, 4), F.array("w", "v")).otherwise(F.array("v"))
    return o.select("o_orderkey", sc.display_matches(shown, values).alias("ok"))


# --- models


def predicted(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("fold", (F.col("vec_id") % 3).cast("int"))
    return model.centroid_predictions(e, "label", "embedding", "fold")


CENTROID = """WITH x AS (SELECT vec_id, label, vec_id % 3 AS fold, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (
  SELECT h.held, label, i, avg(v) AS c FROM x JOIN (SELECT DISTINCT vec_id % 3 AS held FROM embeddings) h ON fold <> held GROUP BY ALL), d AS (
  SELECT x.vec_id, x.label, m.label AS l, sum((m.c - v) * (m.c - v)) AS d FROM x JOIN m ON m.held = x.fold AND m.i = x.i GROUP BY ALL), p AS (SELECT vec_id, any_value(label) AS label, arg_min(l, d) AS predicted FROM d GROUP BY vec_id)"""


@query("confusion_matrix", CENTROID + " SELECT label, predicted, count(*) AS n FROM p GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return model.confusion(predicted(spark, sf_dir), "label", "predicted")


@query("class_recall", CENTROID + f" SELECT label, count(*) AS n, count(*) FILTER (label = predicted) AS hits, {R5('count(*) FILTER (label = predicted) / count(*)')} AS recall FROM p GROUP BY label")
def class_recall(spark, sf_dir):
    return rounded(model.class_recall(predicted(spark, sf_dir), "label", "predicted"), "recall")


@query("leakage_score", CENTROID + f""", r AS (SELECT count(*) FILTER (label = predicted) / count(*) AS recall FROM p GROUP BY label), b AS (SELECT count(*) AS classes, avg(recall) AS ba FROM r), s AS (SELECT classes, ba, greatest(0, least(1, (ba - 1 / classes) / (1 - 1 / classes))) AS score FROM b)
SELECT classes, {R5('ba')} AS balanced_accuracy, {R5('score')} AS score, CASE WHEN score >= 0.5 THEN 'severe' WHEN score >= 0.15 THEN 'moderate' ELSE 'low' END AS severity FROM s""")
def leakage(spark, sf_dir):
    row = model.class_recall(predicted(spark, sf_dir), "label", "predicted").agg(F.count(F.lit(1)).alias("classes"), F.avg("recall").alias("balanced_accuracy"))
    row = row.withColumn("score", sc.leakage_score(F.col("balanced_accuracy"), 1 / F.col("classes"))).withColumn("severity", sc.severity(F.col("score")))
    return rounded(row, "balanced_accuracy", "score")


@query("centroid_recoverability")
def centroid_recoverability(spark, sf_dir):
    return model.recoverability(table(spark, sf_dir, "embeddings"), "label", "embedding", "vec_id")


@query("recoverability_probe")
def recoverability_probe(spark, sf_dir):
    """Scaled class-balanced logistic models on principal components, three folds."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null and label is not null")
    return probe.audit(e, {"embedding": "embedding"}, "label", "vec_id", components=8)


@query("stratified_group_folds")
def stratified_group_folds(spark, sf_dir):
    """Customers dealt whole to folds that have alike shares of priorities."""
    dealt = model.stratified_group_folds(table(spark, sf_dir, "orders"), "o_orderpriority", "o_custkey", 5)
    return dealt.groupBy("fold", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("customers"))


@query("group_folds", """SELECT o_custkey, (CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END)::INT AS fold FROM (SELECT o_custkey, row_number() OVER (ORDER BY count(*) DESC, o_custkey) - 1 AS r FROM orders GROUP BY o_custkey)""")
def group_folds(spark, sf_dir):
    return model.group_folds(table(spark, sf_dir, "orders"), "o_custkey", 5).select("o_custkey", "fold").distinct()


@query("fold_overlap", "SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1")
def fold_overlap(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return model.overlap(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_custkey")


@query("heldout_ridge")
def heldout_ridge(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", (F.col("l_suppkey") % 5).alias("policy"), "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    out = model.held_out_ridge(l, "l_returnflag", "policy", ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", r5(F.col("prediction") / 1e4).alias("prediction"), "alpha")


@query("heldout_ridge_fixed", f"""WITH s AS (SELECT f AS b, count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_pop(l_quantity) AS vx, covar_pop(l_quantity, l_extendedprice) AS cxy
  FROM lineitem, (SELECT DISTINCT l_returnflag AS f FROM lineitem) WHERE f <> l_returnflag GROUP BY f)
SELECT l_orderkey, l_linenumber, l_partkey, {R5('(my + n * cxy / (vx * (n + 10)) * (l_quantity - mx)) / 1e5')} AS prediction, 10.0::DOUBLE AS alpha FROM lineitem JOIN s ON b = l_returnflag""")
def heldout_ridge_fixed(spark, sf_dir):
    """One feature and one alpha, where the model has a closed form."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", (F.col("l_suppkey") % 5).alias("policy"), "l_quantity", "l_extendedprice")
    out = model.held_out_ridge(l, "l_returnflag", "policy", ["l_quantity"], "l_extendedprice", alphas=(10.0,))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", r5(F.col("prediction") / 1e5).alias("prediction"), "alpha")


@query("leave_policy_out", f"""WITH o AS (SELECT o_orderkey, o_custkey AS g, o_totalprice / 1000 AS y, o_orderdate::DATE - DATE '1992-01-01' AS x, o_orderstatus <> 'P' AS t FROM orders),
g AS (SELECT g, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x)::DOUBLE AS sxx, sum(x * y) AS sxy FROM o WHERE t GROUP BY g), a AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM g),
r AS (SELECT k.g, a.n - coalesce(g.n, 0) AS n, a.sx - coalesce(g.sx, 0) AS sx, a.sy - coalesce(g.sy, 0) AS sy, a.sxx - coalesce(g.sxx, 0) AS sxx, a.sxy - coalesce(g.sxy, 0) AS sxy FROM (SELECT DISTINCT g FROM o) k LEFT JOIN g USING (g), a)
SELECT o_orderkey, {R5('(sy / n + (sxy - sx * sy / n) / ((sxx - sx * sx / n) / n * (n + 1)) * (x - sx / n)) / 100')} AS prediction FROM o JOIN r USING (g)""")
def leave_policy_out(spark, sf_dir):
    """A customer is a policy, a pending order a censored cell: scored by a model of the other customers' orders that ended."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", (F.col("o_totalprice") / 1000).alias("y"), F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).alias("x"))
    out = model.leave_group_out(o, "o_custkey", ["x"], "y", 1.0, F.col("o_orderstatus") != "P")
    return out.select("o_orderkey", r5(F.col("prediction") / 100).alias("prediction"))


@query("knn_model")
def knn_model(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("n"), "s_acctbal")
    return model.knn(s.where("s_suppkey % 2 = 0"), s.where("s_suppkey % 2 = 1"), "s_suppkey", ["n"], "s_acctbal")


from . import downstream, files, governance, ledgers, studies  # noqa: E402, F401  they register their queries in the same tables
