"""Queries over files that tasks write from the tables and read again by ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import ranges, strict_json
from .base import query, table


@query(
    "jsonl_rows",
    """SELECT o_orderkey, o_orderkey % 7 <> 0 AS ok, true AS in_place,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority FROM orders""",
)
def jsonl_rows(spark, sf_dir):
    """Orders as JSON lines, read back strictly with their numbers; a key of seven is written twice in its document, which is rejected."""
    o, folder = table(spark, sf_dir, "orders"), f"{ranges.shared_folder(spark)}.jsonl"
    again = F.when(F.col("o_orderkey") % 7 == 0, F.lit(', "k": 0}')).otherwise(F.lit("}"))
    line = F.concat(
        F.lit('{"k": '), F.col("o_orderkey"), F.lit(', "p": "'), F.col("o_orderpriority"),
        F.lit('", "n": '), F.expr("monotonically_increasing_id() & ((1L << 33) - 1)"), again,
    )
    o.select(line.alias("value")).write.text(folder)
    raw = strict_json.numbered_lines(spark, folder)
    rows = strict_json.with_document(raw)
    number = lambda k: F.regexp_extract("value", f'"{k}": ([0-9]+)', 1).cast("long")
    return rows.select(number("k").alias("o_orderkey"), "ok", (F.col("pos") == number("n")).alias("in_place"), strict_json.field("doc", "$.p", "string").alias("priority"))


@query("archived_texts", "SELECT doc_id, length(text) AS n_chars, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def archived_texts(spark, sf_dir):
    """Documents as members of zip archives, one archive a partition, read back member by member from their ranges."""
    d = table(spark, sf_dir, "documents")
    name = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.monotonically_increasing_id())
    made = ranges.write_archives(d.select(name.alias("member"), F.col("text").alias("value")), ranges.shared_folder(spark))
    # one path an archive, as many as the table has partitions
    paths = [r.archive for r in made.where("members > 0").select("archive").collect()]
    if not paths:
        return d.limit(0).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.lit("").alias("sha256"))
    texts = ranges.zip_texts(spark, paths, suffix="")
    key = F.split("member", "/")[0].cast(d.schema["doc_id"].dataType)
    return texts.select(key.alias("doc_id"), F.length("value").cast("long").alias("n_chars"), F.sha2("value", 256).alias("sha256"))
