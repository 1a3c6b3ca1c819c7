"""Append-only event documents as a stream: the batch parser and row rules, with state bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import offset_timestamp
from ..operators import ledger
from ..sources import strict_json


def read(spark: SparkSession, folder: str, time: str = "$.created_at") -> DataFrame:
    """(value, doc, ok, at) of JSON lines that are appended to a folder; rejected lines stay, without a time."""
    lines = spark.readStream.schema("value string").text(folder)
    return strict_json.with_document(lines).withColumn("at", offset_timestamp(strict_json.field("doc", time, "string")))


def first_of_each(stream: DataFrame, key: str = "$.event_id", delay: str = "1 hour") -> DataFrame:
    """Accepted documents with a time, once for each key within the watermark."""
    keyed = stream.where("ok and at is not null").withColumn("key", strict_json.field("doc", key, "string"))
    return keyed.withWatermark("at", delay).dropDuplicatesWithinWatermark(["key"])


def counts(stream: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(window, n, recorded): accepted documents per window, and those with an outcome status."""
    good = stream.where("ok and at is not null").withWatermark("at", delay)
    status = strict_json.field("doc", "$.outcome.status", "string")
    return good.groupBy(F.window("at", window)).agg(F.count(F.lit(1)).alias("n"), F.count(status).alias("recorded"))


def row_issues(stream: DataFrame, kind: str) -> DataFrame:
    """Violations of the rules on single rows of a table, as its rows arrive: no state."""
    return ledger.row_rules(ledger.typed(stream.where("ok"), kind), kind).drop("detail")
