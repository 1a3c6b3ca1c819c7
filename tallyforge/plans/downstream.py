"""Queries of the downstream audit's operators over the star-schema tables, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import downstream, features, model, probe, resample
from ..sources import schema
from .base import R5, query, r5, rounded, table

# --- outcomes: a supplier's shipments as a record of capacities by cycle

_RECORD = """WITH rec AS (SELECT l_suppkey AS unit, l_shipdate::DATE - DATE '1992-01-01' AS cycle, l_quantity / 10 AS q, l_discount < 0.1 AS usable FROM lineitem),
o AS (SELECT unit, min(cycle) FILTER (usable AND q >= 0.5 AND q <= 0.885) AS cycle_life, round(min(q) FILTER (usable AND q >= 0.5), 4) AS least, max(cycle) FILTER (usable) AS last FROM rec GROUP BY unit),
t AS (SELECT *, CASE WHEN cycle_life IS NULL THEN 'unknown' ELSE 'success' END AS status, cycle_life IS NULL AS truncated FROM o)"""


def record(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_suppkey").alias("unit"), F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")).alias("cycle"), (F.col("l_quantity") / 10).alias("q"), (F.col("l_discount") < 0.1).alias("usable"))


@query("outcome_derivation", _RECORD + " SELECT unit, status, cycle_life, least, truncated FROM t")
def outcome_derivation(spark, sf_dir):
    return downstream.outcomes(record(spark, sf_dir), "unit", "cycle", "q", "usable")


# an order's life: shipped orders have one, open ones end early or aren't known
_TARGET = """WITH x AS (SELECT o_orderkey AS unit, o_custkey AS g, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'unknown' END AS status, CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 100 END AS life,
  o_orderstatus = 'O' AND o_orderkey % 2 = 0 AS truncated, (o_orderkey % 900)::DOUBLE AS last, o_custkey % 7 = 0 AS crossed FROM orders),
t AS (SELECT *, CASE WHEN status = 'success' THEN 'observed_eol' WHEN truncated THEN 'right_censored' ELSE 'unavailable_' || coalesce(status, 'unknown') END AS target_status, coalesce(status = 'success', false) AS target_exact,
  CASE WHEN status = 'success' THEN log10(life) END AS log_life, CASE WHEN coalesce(status, '') <> 'success' AND truncated THEN last + 1 END AS lower_bound FROM x)"""


def targets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "unknown")
    x = o.select(F.col("o_orderkey").alias("unit"), F.col("o_custkey").alias("g"), status.alias("status"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") / 100).alias("life"), ((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 2 == 0)).alias("truncated"), (F.col("o_orderkey") % 900).cast("double").alias("last"), (F.col("o_custkey") % 7 == 0).alias("crossed"))
    return downstream.with_target(x, "status", "life", "truncated", "last")


@query("target_derivation", _TARGET + f" SELECT unit, target_status, target_exact, {R5('log_life')} AS log_life, lower_bound FROM t")
def target_derivation(spark, sf_dir):
    return rounded(targets(spark, sf_dir), "log_life").select("unit", "target_status", "target_exact", "log_life", "lower_bound")


def _ledger_sql(primary: bool) -> str:
    crossed = "excluded_cross_batch_target_provenance" if primary else "included_contaminated_cross_batch_target_provenance"
    eligible = "target_exact AND NOT crossed" if primary else "target_exact"
    return f"SELECT unit, CASE WHEN NOT target_exact THEN target_status WHEN crossed THEN '{crossed}' ELSE 'included' END AS reason, {eligible} AS eligible, CASE WHEN {eligible} THEN {R5('abs(3.1 - log_life)')} END AS loss_flat, CASE WHEN {eligible} AND last >= 100 THEN {R5('abs(log10(last) - log_life)')} END AS loss_last FROM t"


def _ledger(spark, sf_dir, primary):
    t = targets(spark, sf_dir).withColumns({"flat": F.lit(3.1), "by_last": F.when(F.col("last") >= 100, F.log10("last"))})
    return rounded(downstream.row_ledger(t, {"flat": "flat", "last": "by_last"}, primary), "loss_flat", "loss_last").select("unit", "reason", "eligible", "loss_flat", "loss_last")


@query("row_ledger_primary", f"{_TARGET} {_ledger_sql(True)}")
def row_ledger_primary(spark, sf_dir):
    return _ledger(spark, sf_dir, True)


@query("row_ledger_sensitivity", f"{_TARGET} {_ledger_sql(False)}")
def row_ledger_sensitivity(spark, sf_dir):
    return _ledger(spark, sf_dir, False)


@query("label_hash", """SELECT c_nationkey, sha256('[' || string_agg('"' || c_mktsegment || '"', ',' ORDER BY c_mktsegment) || ']') AS labels_sha256 FROM customer GROUP BY c_nationkey""")
def label_hash(spark, sf_dir):
    return downstream.label_hash(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment")


# --- contexts and arms

_CONTEXT = """WITH c AS (SELECT p_partkey, p_size::DOUBLE AS size, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'inf'::DOUBLE ELSE p_retailprice END AS price, CASE WHEN p_partkey % 3 > 0 THEN [p_partkey::DOUBLE, 1.0::DOUBLE] END AS grid FROM part),
r AS (SELECT *, CASE WHEN price IS NULL THEN 'missing_or_malformed_context' WHEN isinf(price) THEN 'nonfinite_context' ELSE 'available' END AS reason, CASE WHEN grid IS NULL THEN 'missing' ELSE 'available' END AS grid_reason FROM c)"""


def contexts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    price = F.when(k % 5 == 0, "not a number").when(k % 5 == 1, "Infinity").otherwise(F.col("p_retailprice").cast("string"))
    values, reason = downstream.context_vector(F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("price"), price), ["size", "price"])
    grid = F.when(k % 3 > 0, F.array(k.cast("double"), F.lit(1.0)))
    return p.select("p_partkey", values.alias("context"), reason.alias("context_reason"), grid.alias("grid"), F.when(grid.isNull(), "missing").otherwise("available").alias("grid_reason"))


@query("context_vector", f"{_CONTEXT} SELECT p_partkey, reason, size, price FROM r")
def context_vector(spark, sf_dir):
    return contexts(spark, sf_dir).select("p_partkey", F.col("context_reason").alias("reason"), F.col("context")[0].alias("size"), F.col("context")[1].alias("price"))


@query("feature_arms", f"""{_CONTEXT} SELECT p_partkey, 'C' AS arm, CASE WHEN reason = 'available' THEN 'available' ELSE 'context:' || reason END AS reason, CASE WHEN reason = 'available' THEN 2 END AS width, CASE WHEN reason = 'available' THEN {R5('size + price')} END AS total FROM r
UNION ALL SELECT p_partkey, 'C_grid', CASE WHEN reason <> 'available' THEN 'context:' || reason WHEN grid IS NULL THEN 'part:missing' ELSE 'available' END, CASE WHEN reason = 'available' AND grid IS NOT NULL THEN 4 END, CASE WHEN reason = 'available' AND grid IS NOT NULL THEN {R5('size + price + grid[1] + grid[2]')} END FROM r""")
def feature_arms(spark, sf_dir):
    out = downstream.feature_arms(contexts(spark, sf_dir), "context", "context_reason", {"grid": "grid"}, "grid_reason", {"C": [], "C_grid": ["grid"]})
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return out.select("p_partkey", "arm", "reason", F.when(F.col("vector").isNotNull(), F.size("vector")).alias("width"), r5(total).alias("total"))


# --- plausibility, ranges, invariants


@query("prediction_plausibility", f"""SELECT l_returnflag AS arm, count(*) AS predictions, {R5('min(p)')} AS least_log, {R5('max(p)')} AS most_log, count(*) FILTER (pow(10, p) < 101) AS below_floor, list_sort(list(k) FILTER (pow(10, p) < 101))[1] AS first_below
FROM (SELECT l_returnflag, l_orderkey AS k, CASE WHEN l_tax > 0.01 THEN 1 + l_quantity / 10 + l_discount / 100 END AS p FROM lineitem) WHERE p IS NOT NULL GROUP BY 1""")
def prediction_plausibility(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("arm"), "l_orderkey", F.when(F.col("l_tax") > 0.01, 1 + F.col("l_quantity") / 10 + F.col("l_discount") / 100).alias("p"))
    out = downstream.plausibility(l, "arm", "p", "l_orderkey")
    return rounded(out, "least_log", "most_log").select("arm", "predictions", "least_log", "most_log", "below_floor", "first_below")


@query("value_ranges", f"SELECT unnest(['l_quantity', 'l_discount', 'l_extendedprice']) AS name, unnest([{R5('min(l_quantity)')}, {R5('min(l_discount)')}, {R5('min(l_extendedprice)')}]) AS least, unnest([{R5('max(l_quantity)')}, {R5('max(l_discount)')}, {R5('max(l_extendedprice)')}]) AS most FROM lineitem")
def value_ranges(spark, sf_dir):
    return rounded(downstream.ranges(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"]), "least", "most")


@query("list_histogram", "SELECT value, count(*) AS rows FROM (SELECT DISTINCT l_orderkey, l_linenumber AS value FROM lineitem) GROUP BY value")
def list_histogram(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("v"))
    return downstream.histogram(l, "v")


@query("dataset_invariants", """SELECT unnest(['rows', 'customers', 'negative', 'dear']) AS name, unnest([count(*), count(DISTINCT o_custkey), count(*) FILTER (o_totalprice < 0), count(*) FILTER (o_totalprice > 100000)]) AS actual,
  unnest([NULL, NULL, 0, -1]::BIGINT[]) AS expected, unnest([true, true, count(*) FILTER (o_totalprice < 0) = 0, false]) AS ok FROM orders""")
def dataset_invariants(spark, sf_dir):
    price = F.col("o_totalprice")
    return downstream.invariants(table(spark, sf_dir, "orders"), {"rows": F.count(F.lit(1)), "customers": F.countDistinct("o_custkey"), "negative": F.count_if(price < 0), "dear": F.count_if(price > 100000)}, {"negative": 0, "dear": -1})


# --- verdicts


@query("ordering_verdict", f"""WITH m AS (SELECT l_suppkey, avg(abs(l_discount - 0.05)) FILTER (l_linenumber > 2) AS ps, avg(abs(l_tax - 0.03)) FILTER (l_linenumber > 2) AS px, avg(abs(l_discount - 0.05)) AS ss, avg(abs(l_tax - 0.03)) AS sx FROM lineitem GROUP BY 1)
SELECT l_suppkey, {R5('ps - px')} AS primary_gap, {R5('ss - sx')} AS sensitivity_gap, CASE WHEN abs(ps - px) < 1e-9 THEN 'near' WHEN ps > px THEN 'px_lower_risk' ELSE 'ps_lower_risk' END AS primary_ordering, (ps - px) * (ss - sx) < 0 AND abs(ps - px) >= 1e-9 AND abs(ss - sx) >= 1e-9 AS reverses FROM m""")
def ordering_verdict(spark, sf_dir):
    d, t, late = F.abs(F.col("l_discount") - 0.05), F.abs(F.col("l_tax") - 0.03), F.col("l_linenumber") > 2
    m = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg(F.when(late, d)).alias("ps"), F.avg(F.when(late, t)).alias("px"), F.avg(d).alias("ss"), F.avg(t).alias("sx"))
    out = downstream.ordering_verdict(m, ("ps", "px"), ("ss", "sx"))
    near = lambda c: F.abs(F.col(c)) < 1e-9  # noqa: E731  ties by the order of adding
    out = out.withColumns({"reverses": F.col("reverses") & ~near("primary_gap") & ~near("sensitivity_gap"), "primary_ordering": F.when(near("primary_gap"), "near").otherwise(F.col("primary_ordering"))})
    return rounded(out, "primary_gap", "sensitivity_gap").select("l_suppkey", "primary_gap", "sensitivity_gap", "primary_ordering", "reverses")


@query("transfer_verdicts", """WITH v AS (SELECT l_suppkey % 20 AS g, l_returnflag AS e, CASE WHEN avg(l_discount) > 0.0495 THEN 'loss_detected' WHEN avg(l_discount) > 0.03 THEN 'bounded_event_support_and_common_risk' ELSE 'inconclusive' END AS verdict FROM lineitem GROUP BY ALL)
SELECT g, count(*) AS environments, CASE WHEN count(*) < 2 THEN 'not_estimable' WHEN bool_and(verdict = 'loss_detected') THEN 'loss_detected_in_every_observed_environment' WHEN bool_and(verdict LIKE 'bounded%') THEN 'bounded_event_support_and_common_risk_in_every_observed_environment' ELSE 'inconclusive_or_heterogeneous' END AS consistency,
  CASE WHEN count(*) < 2 THEN 'not_estimable' WHEN bool_and(verdict = 'loss_detected') THEN 'loss_detected_in_every_held_out_environment' WHEN bool_and(verdict LIKE 'bounded%') THEN 'bounded_event_support_and_common_risk_in_every_held_out_environment' ELSE 'inconclusive_or_heterogeneous_across_held_out_environments' END AS transfer FROM v GROUP BY g""")
def transfer_verdicts(spark, sf_dir):
    mean = F.avg("l_discount")
    v = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("g"), "l_returnflag").agg(F.when(mean > 0.0495, "loss_detected").when(mean > 0.03, "bounded_event_support_and_common_risk").otherwise("inconclusive").alias("verdict"))
    return downstream.environment_verdicts(v, "verdict", ["g"])


@query("robustness_bar", "SELECT count(*) AS models, count(*) FILTER (a >= 0.6 AND b > 0.5) AS clearing, count(*) FILTER (a >= 0.6 AND b > 0.5) >= 3 AS confirmed FROM (SELECT l_suppkey, avg((l_quantity > 19)::INT) AS a, avg((l_quantity > 22)::INT) AS b FROM lineitem GROUP BY 1)")
def robustness_bar(spark, sf_dir):
    q = F.col("l_quantity")
    m = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg((q > 19).cast("int")).alias("a"), F.avg((q > 22).cast("int")).alias("b"))
    return downstream.robustness(m, "a", "b")


@query("pair_collision_audit", f"""WITH rep AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 <> 0 THEN floor(o_totalprice / 50000)::BIGINT END AS token FROM orders), p AS (
  SELECT o_orderkey AS l, o_orderkey + 1 AS r, 1.0::DOUBLE + o_orderkey % 3 AS w FROM orders WHERE o_orderstatus <> 'P'), m AS (SELECT w, a.token AS lt, b.token AS rt FROM p LEFT JOIN rep a ON a.id = l LEFT JOIN rep b ON b.id = r), s AS (
  SELECT count(*) AS n, count(*) FILTER (lt IS NOT NULL AND rt IS NOT NULL) AS t, count(*) FILTER (lt = rt) AS h, sum(w) AS w, sum(w) FILTER (lt IS NOT NULL AND rt IS NOT NULL) AS wt, sum(w) FILTER (lt = rt) AS wh FROM m)
SELECT n AS decisions, t AS representable, h AS collisions, {R5('t / n')} AS coverage, {R5('wt / w')} AS weight_coverage, {R5('h / t')} AS collision_rate, {R5('wh / wt')} AS weighted_collision_rate, {R5('1 - h / t / 2')} AS ceiling, {R5('1 - wh / wt / 2')} AS weighted_ceiling,
  CASE WHEN 1 - t / n > 0.9 OR 1 - wt / w > 0.95 THEN 'decision_support_loss' ELSE 'within_decision_support_tolerances' END AS support_verdict, CASE WHEN h / t > 0.9 OR wh / wt > 0.05 THEN 'collision_bound_exceeded' ELSE 'within_collision_tolerance' END AS collision_verdict FROM s""")
def pair_collision_audit(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rep = o.select(F.col("o_orderkey").alias("row_id"), F.when(F.col("o_orderkey") % 11 != 0, F.floor(F.col("o_totalprice") / 50000)).alias("token"))
    pairs = o.select(F.col("o_orderkey").alias("left_id"), (F.col("o_orderkey") + 1).alias("right_id"), (F.lit(1.0) + F.col("o_orderkey") % 3).alias("weight"), (F.col("o_orderstatus") != "P").alias("universe"))
    return rounded(downstream.pair_collision_audit(rep, pairs, 0.9, 0.95, 0.9, 0.05), "coverage", "weight_coverage", "collision_rate", "weighted_collision_rate", "ceiling", "weighted_ceiling")


def _comparison(name: str, c: str, r: str, cl: str, rl: str) -> str:
    return f"""SELECT '{name}' AS comparison, count(*) FILTER ({c}) AS compact_count, count(*) FILTER ({r}) AS reference_count, count(*) FILTER ({c} AND {r}) AS common_count,
  {R5(f'sum(w * {cl}) FILTER ({c} AND {r}) / sum(w) FILTER ({c} AND {r})')} AS compact_risk, {R5(f'sum(w * {rl}) FILTER ({c} AND {r}) / sum(w) FILTER ({c} AND {r})')} AS reference_risk FROM a"""


@query("audit_comparisons", "WITH a AS (SELECT 1.0::DOUBLE + l_linenumber AS w, l_quantity > 2 AS qa, l_discount < 0.1 AS da, l_tax > 0 AS ta, abs(l_extendedprice / 1000 - 50) AS ql, abs(l_extendedprice / 1000 - l_quantity * 2) AS dl, abs(l_extendedprice / 1000 - 40) AS tl FROM lineitem) " + " UNION ALL ".join([_comparison("q__to__d", "qa", "da", "ql", "dl"), _comparison("t__to__d", "ta", "da", "tl", "dl")]))
def audit_comparisons(spark, sf_dir):
    y = F.col("l_extendedprice") / 1000
    l = table(spark, sf_dir, "lineitem").select(
        F.lit(True).alias("universe"), F.lit(1.0).alias("importance"), (F.lit(1.0) + F.col("l_linenumber")).alias("weight"), (F.col("l_quantity") > 2).alias("qa"), (F.col("l_discount") < 0.1).alias("da"), (F.col("l_tax") > 0).alias("ta"),
        sc.absolute_error(y, F.lit(50.0)).alias("ql"), sc.absolute_error(y, F.col("l_quantity") * 2).alias("dl"), sc.absolute_error(y, F.lit(40.0)).alias("tl"),
    )
    out = downstream.audit_comparisons(l, {"q": ("qa", "ql"), "d": ("da", "dl"), "t": ("ta", "tl")}, [("q", "d"), ("t", "d")])
    return rounded(out, "compact_risk", "reference_risk").select("comparison", "compact_count", "reference_count", "common_count", "compact_risk", "reference_risk")


@query("custom_risk", f"SELECT l_returnflag, count(*) AS n, {R5('max(abs(l_quantity - 25) * l_linenumber)')} AS risk FROM lineitem GROUP BY 1")
def custom_risk(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("p", F.lit(25.0))
    return rounded(downstream.risk_with(l, "l_quantity", "p", lambda y, p: F.abs(y - p), F.col("l_linenumber"), lambda x, w: F.max(x * w), ["l_returnflag"]), "risk")


@query("mean_bootstrap")
def mean_bootstrap(spark, sf_dir):
    return resample.bootstrap_mean(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey", "o_custkey")


# --- adapters and ledgers


@query("continuation_groups", """WITH r AS (SELECT CASE WHEN c_custkey % 50 <> 49 THEN c_custkey // 3 END AS b, c_custkey AS part,
  CASE WHEN c_custkey % 3 = 0 THEN 'FULL-' || c_mktsegment WHEN c_custkey % 40 <> 8 THEN c_mktsegment END AS p FROM customer),
l AS (SELECT b, arg_max(p, (length(p), p)) AS canonical, count(*) AS n FROM r GROUP BY b),
m AS (SELECT r.*, canonical, n, r.b IS NOT NULL AND bool_and(coalesce(ends_with(canonical, p), false)) OVER (PARTITION BY r.b) AS ok FROM r JOIN l ON r.b IS NOT DISTINCT FROM l.b)
SELECT CASE WHEN ok THEN b::VARCHAR WHEN b IS NULL THEN part::VARCHAR ELSE b || ':' || part END AS event_id, b AS barcode, count(*) AS records,
  CASE WHEN bool_and(ok) THEN min(canonical) ELSE min(p) END AS policy, bool_and(ok) AND min(n) > 1 AS merged FROM m GROUP BY 1, 2""")
def continuation_groups(spark, sf_dir):
    """Every fiftieth customer has no barcode, every fortieth no policy."""
    k, segment = F.col("c_custkey"), F.col("c_mktsegment")
    policy = F.when(k % 3 == 0, F.concat(F.lit("FULL-"), segment)).when(k % 40 != 8, segment)
    rows = table(spark, sf_dir, "customer").select(F.when(k % 50 != 49, F.floor(k / 3)).alias("barcode"), k.alias("part"), policy.alias("policy"))
    return downstream.continuation_groups(rows, "barcode", "policy", "part")


@query("ordered_observations", "SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS cycles FROM lineitem GROUP BY 1")
def ordered_observations(spark, sf_dir):
    out = downstream.ordered_observations(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity")
    return out.select("l_orderkey", F.array_join(F.transform("observations", lambda o: o["l_linenumber"].cast("string")), ",").alias("cycles"))


@query("raman_observations", """SELECT 'R' || c_custkey // 4 AS specimen, CASE c_nationkey % 3 WHEN 0 THEN 514.5 WHEN 1 THEN 780 ELSE -1 END::DOUBLE AS line_nm, CASE WHEN bool_or(c_custkey % 2 = 0) THEN 'Processed' ELSE 'RAW' END AS selected, bool_or(c_custkey % 2 = 0) AND bool_or(c_custkey % 2 = 1) AS has_other FROM customer WHERE c_custkey % 10 <> 9 GROUP BY ALL""")
def raman_observations(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    line = F.when(n % 3 == 0, "514-5").when(n % 3 == 1, "780").otherwise("")
    name = F.concat(F.lit("a/Quartz__R"), F.floor(k / 4).cast("string"), F.lit("__Raman__"), line, F.lit("__Raman_Data_"), F.when(k % 2 == 0, "Processed").otherwise("RAW"), F.lit("__"), F.hex(k), F.when(k % 10 == 9, ".md").otherwise(".txt"))
    out, _ = downstream.raman_observations(table(spark, sf_dir, "customer").select(name.alias("name")), "name")
    return out.select("specimen", "line_nm", "selected", F.col("other_member").isNotNull().alias("has_other"))


_SHOWN = "list_transform(regexp_extract_all({0}, '-?[0-9]+[.]?[0-9]*'), lambda t: {{'n': t::DOUBLE, 'p': CASE WHEN contains(t, '.') THEN length(split_part(t, '.', 2)) ELSE 0 END}})"
_MATCHES = "(len({0}) = len({1}) AND len(list_filter(list_zip({0}, {1}), lambda z: round(z[1], (z[2]).p::INT) <> (z[2]).n)) = 0)"


@query("pointer_join", f"""WITH e AS (SELECT event_id, (props->>'$.k')::BIGINT AS k, value / 7 AS v FROM events),
x AS (SELECT event_id, k, v, CASE event_id % 5 WHEN 0 THEN 'about ' || k WHEN 1 THEN 'in 2024: ' || k WHEN 2 THEN '100000' WHEN 3 THEN k || '.0' ELSE NULL END AS shown,
  CASE event_id % 3 WHEN 0 THEN k || ' to ' || (k + 1) WHEN 1 THEN '[' || k || ', ' || k || ']' ELSE 'none' END AS ci FROM e),
y AS (SELECT *, {_SHOWN.format('shown')} AS ns, {_SHOWN.format('ci')} AS nc FROM x)
SELECT event_id AS key, 'pointer' AS field, CASE WHEN event_id % 7 <> 6 THEN k::VARCHAR END AS value,
  CASE WHEN shown IS NULL THEN 'undisplayed' WHEN event_id % 7 = 6 THEN 'unresolved' WHEN {_MATCHES.format('[k]', 'ns')} THEN 'ok' ELSE 'stale' END AS state FROM y
UNION ALL SELECT event_id, 'ci_pointer', '[' || k || ',' || (k + 1) || ']', CASE WHEN {_MATCHES.format('[k, k + 1]', 'nc')} THEN 'ok' ELSE 'stale' END FROM y""")
def pointer_join(spark, sf_dir):
    """Scalars shown alone, beside a year, wrongly, with a decimal or not at all; bounds shown as two numbers, one twice, or none."""
    e, i, k = table(spark, sf_dir, "events"), F.col("event_id"), F.get_json_object("props", "$.k")
    path = F.concat(F.lit("m/"), i.cast("string")).alias("manifest")
    body = F.concat(F.lit('{"runs": [{"v": '), F.col("props"), F.lit(', "ci": ['), k, F.lit(", "), (k.cast("long") + 1).cast("string"), F.lit("]}]}"))
    shown = F.when(i % 5 == 0, F.concat(F.lit("about "), k)).when(i % 5 == 1, F.concat(F.lit("in 2024: "), k)).when(i % 5 == 2, "100000").when(i % 5 == 3, F.concat(k, F.lit(".0")))
    bounds = F.when(i % 3 == 0, F.concat(k, F.lit(" to "), (k.cast("long") + 1).cast("string"))).when(i % 3 == 1, F.concat(F.lit("["), k, F.lit(", "), k, F.lit("]"))).otherwise("none")
    entries = e.select(
        i.alias("key"), path, F.when(i % 7 == 6, "runs[7].v.k").otherwise("runs[0].v.k").alias("pointer"), shown.alias("display"), F.lit("runs.0.ci").alias("ci_pointer"), bounds.alias("ci95_display")
    )
    return downstream.ledger_check(entries, e.select(path, body.alias("body")))


# --- designs

_DESIGN = "WITH d AS (SELECT c AS condition, r AS replicate, (c + r) % 3 AS session, (c + c // 2 + r) % 2 AS operator, (c + r * 3) % 4 AS lot FROM range(16) a(c), range(3) b(r))"


@query("design_checks", f"""{_DESIGN}, n AS (SELECT condition, count(DISTINCT session) AS s, count(DISTINCT operator) AS o, count(DISTINCT lot) AS l FROM d GROUP BY condition)
SELECT condition::VARCHAR AS "group", unnest(['session', 'operator', 'lot']) AS factor, unnest([s, o, l]) AS actual, unnest([3, 2, 2]::BIGINT[]) AS expected, unnest([s = 3, o = 2, l = 2]) AS ok FROM n""")
def design_checks(spark, sf_dir):
    return downstream.design_checks(features.counterbalanced_design(spark), "condition", {"session": 3, "operator": 2, "lot": 2})


@query("design_skeletons", _DESIGN + """ SELECT printf('c%02d-r%d', condition, replicate) AS event_id, printf('c%02d', condition) AS plan_id, printf('c%02d-r%d:t%d', condition, replicate, m) AS observation_id, m::DOUBLE AS timepoint_minutes, 'unknown' AS outcome, session, operator, lot FROM d, (SELECT unnest([5, 15, 60, 1440]) AS m)""")
def design_skeletons(spark, sf_dir):
    return downstream.skeleton_events(features.counterbalanced_design(spark)).drop("run_order")


# --- models


@query("linear_forecast", f"""WITH s AS (SELECT user_id, ts::DATE - DATE '2024-01-01' AS day, sum(trunc(value * 100)::BIGINT)::DOUBLE AS y FROM events GROUP BY ALL), f AS (SELECT user_id, regr_slope(y, day) AS b, regr_intercept(y, day) AS a, count(*) AS n FROM s WHERE day < 20 GROUP BY 1)
SELECT s.user_id, day::INT AS day, {R5('(a + b * day) / 1000')} AS forecast, {R5('abs(a + b * day - y) / 1000')} AS error FROM s JOIN f ON s.user_id = f.user_id WHERE day >= 20 AND n >= 3""")
def linear_forecast(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = e.groupBy("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day")).agg(F.sum((F.col("value") * 100).cast("long")).cast("double").alias("y"))
    out = probe.linear_forecast(s, "user_id", "day", "y", 20, 3)
    return out.select("user_id", "day", r5(F.col("forecast") / 1000).alias("forecast"), r5(F.col("error") / 1000).alias("error"))


@query("prediction_below_floor", "SELECT l_returnflag AS arm, l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_tax > 0.01 AND pow(10, 1 + l_quantity / 10 + l_discount / 100) < 101")
def prediction_below_floor(spark, sf_dir):
    p = F.when(F.col("l_tax") > 0.01, 1 + F.col("l_quantity") / 10 + F.col("l_discount") / 100)
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("key")
    out = downstream.below_floor(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("arm"), key, p.alias("p")), "arm", "p", "key")
    return out.select("arm", "key.*")


@query("knn_regression", f"""WITH s AS (SELECT s_suppkey AS k, s_nationkey::DOUBLE AS x, s_acctbal AS y FROM supplier), r AS (SELECT a.k, b.y, row_number() OVER (PARTITION BY a.k ORDER BY (a.x - b.x) * (a.x - b.x), b.k) AS n FROM s a, s b)
SELECT k AS s_suppkey, {R5('avg(y) / 100')} AS prediction FROM r WHERE n <= 5 GROUP BY k""")
def knn_regression(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("n"), "s_acctbal")
    return model.knn(s, s, "s_suppkey", ["n"], "s_acctbal").select("s_suppkey", r5(F.col("prediction") / 100).alias("prediction"))


@query("model_registry")
def model_registry(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 3).alias("fold"), F.array(F.col("s_nationkey").cast("double"), (F.col("s_suppkey") % 7).cast("double")).alias("x"), "s_acctbal")
    rows = []
    for name in ("ridge", "forest", "gradient_boosting"):
        done = probe.held_out_predictions(s, "fold", "x", "s_acctbal", name)
        rows.append(done.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("prediction") - F.col("s_acctbal"))).alias("mae")).withColumn("model", F.lit(name)))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# --- schemas

_SCHEMAS = {"event.json": {"type": "object", "required": ["k", "kind"], "additionalProperties": False, "properties": {"k": {"$ref": "parts.json#/$defs/small"}, "kind": {"enum": ["error", "purchase", "click"]}}}, "parts.json": {"$defs": {"small": {"type": "integer", "maximum": 60}}}}


@query("schema_errors", """WITH e AS (SELECT event_id, (props->>'$.k')::INT AS k, event_type AS t FROM events), x AS (
  SELECT event_id, '$.k' AS path, 'breaks maximum 60' AS message FROM e WHERE k > 60 UNION ALL SELECT event_id, '$.kind', 'is not one of the values allowed' FROM e WHERE event_id % 4 > 0 AND t NOT IN ('error', 'purchase', 'click')
  UNION ALL SELECT event_id, '$', 'lacks kind' FROM e WHERE event_id % 4 = 0 UNION ALL SELECT event_id, '$.extra', 'is not allowed' FROM e WHERE event_id % 4 = 0) SELECT * FROM x""")
def schema_errors(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    whole = F.concat(F.lit('{"k": '), F.col("k"), F.when(F.col("event_id") % 4 == 0, ', "extra": 1}').otherwise(F.concat(F.lit(', "kind": "'), F.col("event_type"), F.lit('"}'))))
    return schema.schema_errors(e.select("event_id", whole.alias("d")), "event_id", "d", _SCHEMAS, "event.json")
