"""Event grammar: a typed projection of strict JSON documents, and its predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.strict_json import field

#: The provenance axes, the outcome states that count as negative.
AXES = ("operator_id", "lab_id", "batch_id", "lot_id", "instrument_id", "instrument_session_id", "measurement_day", "run_order")
NEGATIVE = ("failure", "ambiguous", "aborted")
INDEXES = ("timestamp", "timepoint_minutes", "time_s", "cycle_index", "frame_index", "order_index")


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _observation(o: Column) -> Column:
    x, y = field(o, "$.spatial_position.x", "double"), field(o, "$.spatial_position.y", "double")
    payload = F.try_variant_get(o, "$.payload", "variant")
    return F.struct(
        *[field(o, f"$.{n}", "string").alias(n) for n in ("observation_id", "modality", "kind", "stage")],
        F.coalesce(field(o, "$.timestamp", "string"), field(o, "$.measurement_time", "string")).alias("timestamp"),
        *[field(o, f"$.{n}", "double").alias(n) for n in INDEXES[1:]],
        F.when(x.isNotNull() | y.isNotNull(), F.struct(x.alias("x"), y.alias("y"))).alias("spatial_position"),
        F.coalesce(_is_object(payload) & (F.schema_of_variant(payload) != "OBJECT<>"), F.lit(False)).alias("has_values"),
        payload.alias("payload"),
        field(o, "$.file_path", "string").alias("file_path"),
        field(o, "$.include_in_raw_objective", "boolean").alias("include_in_raw_objective"),
    )


def parse_events(df: DataFrame, doc: str = "doc") -> DataFrame:
    """Typed events of ``doc`` (variant).  A missing system is ``unknown``; observations that aren't
    objects are dropped; ``planned`` that isn't an object is empty; an explicit status makes the
    outcome recorded, a missing one leaves it ``unknown`` and not recorded."""
    d = F.col(doc)
    items = F.coalesce(F.try_variant_get(d, "$.observations", "array<variant>"), F.array().cast("array<variant>"))
    entries = F.coalesce(F.try_variant_get(d, "$.labels.entries", "array<variant>"), F.array().cast("array<variant>"))
    label = F.filter(F.transform(entries, lambda e: F.struct(F.coalesce(field(e, "$.labeler_id", "string"), F.lit("unknown")).alias("labeler_id"), field(e, "$.label", "string").alias("label"))), lambda e: e["label"].isNotNull())
    status = field(d, "$.outcome.status", "string")
    axes = [(field(d, f"$.provenance.{a}", "double").cast("string") if a == "run_order" else field(d, f"$.provenance.{a}", "string")).alias(a) for a in AXES]
    return df.select(
        field(d, "$.event_id", "string").alias("event_id"),
        F.coalesce(field(d, "$.system", "string"), F.lit("unknown")).alias("system"),
        F.struct(field(d, "$.intent.plan_id", "string").alias("plan_id"), field(d, "$.intent.event_group_id", "string").alias("event_group_id"), F.coalesce(F.try_variant_get(d, "$.intent.planned", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("planned")).alias("intent"),
        F.transform(F.filter(items, _is_object), _observation).alias("observations"),
        F.struct(F.coalesce(status, F.lit("unknown")).alias("status"), status.isNotNull().alias("recorded")).alias("outcome"),
        F.struct(*axes).alias("provenance"),
        F.struct(field(d, "$.labels.assigned_after_raw_data_frozen", "boolean").alias("frozen"), label.alias("entries")).alias("labels"),
    )


def has_payload(o: Column) -> Column:
    return o["has_values"] | o["file_path"].isNotNull()


def has_index(o: Column) -> Column:
    found = o["spatial_position"].isNotNull()
    for name in INDEXES:
        found = found | o[name].isNotNull()
    return found


def accepted(flag: Column) -> Column:
    """Only an explicit false rejects."""
    return F.coalesce(flag, F.lit(True))


def plan_signature(planned: Column, plan_id: Column, group_id: Column) -> Column:
    """Sorted planned pairs without empty values, else the plan, else the group, else null."""
    entries = F.array_sort(F.map_entries(F.map_filter(planned, lambda _, v: v.isNotNull() & (v != ""))))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return F.coalesce(F.when(F.size(entries) > 0, text), F.concat(F.lit("plan:"), F.nullif(plan_id, F.lit(""))), F.concat(F.lit("group:"), F.nullif(group_id, F.lit(""))))


def flatten(events: DataFrame) -> DataFrame:
    """What grading needs of each event, one row: see ``conformance.grade``."""
    obs = F.col("observations")
    return events.select(
        "event_id",
        F.size(obs).alias("n_obs"),
        F.exists(obs, has_payload).alias("payload"),
        F.forall(obs, has_index).alias("indexed"),
        F.col("outcome.status").alias("status"),
        F.col("outcome.recorded").alias("recorded"),
        (F.size("labels.entries") > 0).alias("labelled"),
        F.col("labels.frozen").alias("frozen"),
        plan_signature(F.col("intent.planned"), F.col("intent.plan_id"), F.col("intent.event_group_id")).alias("signature"),
        *[F.col(f"provenance.{a}").alias(a) for a in AXES],
    )
