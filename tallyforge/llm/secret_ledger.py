"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of every path is content-addressed (SHA-256).  Only pairs of a blob and a rule
version that the ledger hasn't seen are scanned, each blob once however many paths hold it,
and findings are joined back to all paths.  Offsets are code points, the end is exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash


@dataclass(frozen=True)
class Rule:
    """``pattern``: leftmost non-overlapping matches; ``group`` must have ``least`` code points.
    ``hint``: a pattern that every text with a finding matches, cheap to test."""

    kind: str
    version: int
    pattern: str
    hint: str
    group: int = 0
    least: int = 0

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


_NAMES = r"(?i:password|passwd|secret|token|api_?key)"
BASE = (
    Rule("assign", 1, "(" + _NAMES + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _NAMES + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{14}", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", r"[0-9a-f]{16}"),
)
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----", r"-----BEGIN "),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"eyJ[A-Za-z0-9_-]{8}"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", r"xox[abprs]-"),
    Rule("maps", 1, r"AIza[0-9A-Za-z_-]{35}", r"AIza[0-9A-Za-z_-]{35}"),
)
RULES = BASE + MORE
SALTS = 16


def _matches(text: Column, rule: Rule) -> Column:
    """For each match in order: code points before it since the last, its own, and whether it counts."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    zipped = F.arrays_zip(whole.alias("w"), part.alias("p"), F.split(text, rule.pattern, -1).alias("g"))
    rows = F.transform(F.filter(zipped, lambda z: z["w"].isNotNull()), lambda z: F.struct(F.lit(rule.id).alias("rule"), F.length(z["g"]).cast("long").alias("gap"), F.length(z["w"]).cast("long").alias("len"), (F.length(z["p"]) >= rule.least).alias("ok")))
    return F.when(F.array_contains("todo", rule.id) & text.rlike(rule.hint), rows).otherwise(F.array().cast("array<struct<rule:string,gap:bigint,len:bigint,ok:boolean>>"))


def content_address(versions: DataFrame, text: str = "text") -> DataFrame:
    """``versions`` with the column ``blob``; null text is the empty text."""
    return versions.withColumn("blob", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def scan_unseen(blobs: DataFrame, rules: tuple = RULES, seen: DataFrame | None = None) -> DataFrame:
    """Findings (blob, kind, rule, start, end) of blobs (blob, body; each blob once), only for
    rule versions that ``seen`` (blob, rule) doesn't have for the blob."""
    every = F.array(*[F.lit(r.id) for r in rules])
    if seen is None:
        todo = blobs.withColumn("todo", every)
    else:
        done = seen.groupBy("blob").agg(F.collect_set("rule").alias("done"))
        todo = blobs.join(done, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))))
    todo = todo.where(F.size("todo") > 0)
    hits = todo.select("blob", F.posexplode(F.concat(*[_matches(F.col("body"), r) for r in rules])).alias("i", "m"))
    hits = hits.select("blob", "i", "m.*")
    upto = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(upto)
    hits = hits.withColumn("end", end).withColumn("start", F.col("end") - F.col("len"))
    return hits.where("ok").select("blob", F.split_part("rule", F.lit("@"), F.lit(1)).alias("kind"), "rule", "start", "end")


def scan(versions: DataFrame, rules: tuple = RULES, ledger: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Findings of each distinct blob of ``versions``: blob, kind, rule, start, end.

    ``ledger``: a folder that keeps which (blob, rule version) pairs were scanned and what was
    found; only unseen pairs are scanned, and the ledger grows by them.  Without it every
    pair is unseen.  A blob is scanned at one of its rows: the others are joined to it by
    address, so no task ever gathers the copies of a text (but for those with the same key).
    """
    spark = versions.sparkSession
    # a struct is never null, so null keys compare as equal and are dealt like all others
    rows = content_address(versions.select(F.struct(F.col(key).alias("id")).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body")), "body")
    one = rows.groupBy("blob").agg(F.struct(F.min("key.id").alias("id")).alias("key"))
    seen = old = None
    if ledger and _exists(spark, f"{ledger}/scanned"):
        seen, old = spark.read.parquet(f"{ledger}/scanned"), spark.read.parquet(f"{ledger}/findings")
        known = seen.groupBy("blob").agg(F.collect_set("rule").alias("done"))
        one = one.join(known, "blob", "left").where(F.size(F.array_except(F.array(*[F.lit(r.id) for r in rules]), F.coalesce("done", F.array().cast("array<string>")))) > 0).select("blob", "key")
    # rows that repeat key and text are still several; they lie in one partition already
    picked = rows.join(one.hint("merge"), ["blob", "key"], "left_semi").dropDuplicates(["blob", "key"])
    found = scan_unseen(picked.select("blob", "body"), rules, seen).distinct()
    if not ledger:
        return found
    found = stash(found, "findings")
    done = stash(one.select("blob", F.explode(F.array(*[F.lit(r.id) for r in rules])).alias("rule")).join(seen, ["blob", "rule"], "left_anti") if seen is not None else one.select("blob", F.explode(F.array(*[F.lit(r.id) for r in rules])).alias("rule")), "scanned")
    found.write.mode("append").parquet(f"{ledger}/findings")
    done.write.mode("append").parquet(f"{ledger}/scanned")  # last: an unfinished scan is scanned again
    current = F.col("rule").isin([r.id for r in rules])
    return (found if old is None else found.unionByName(old)).where(current).distinct()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def per_blob(found: DataFrame, rules: tuple = RULES) -> DataFrame:
    """One row per blob with a finding: its spans in order of start, then of the rule list."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    spans = found.select("blob", F.struct("start", order[F.col("kind")].alias("o"), "end", "kind").alias("s"))
    return spans.groupBy("blob").agg(F.array_sort(F.collect_list("s")).alias("found"))


def to_paths(versions: DataFrame, findings: DataFrame, salts: int = SALTS) -> DataFrame:
    """Findings per blob joined back to every row of ``versions`` (row, blob, spread).  The blob of
    a very large group of copies is salted: its few findings are repeated, its rows are dealt out
    by ``spread``."""
    salted = findings.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = versions.withColumn("salt", F.pmod(F.xxhash64("spread"), F.lit(salts)).cast("int")).drop("spread")
    return rows.join(salted, ["blob", "salt"], "left").drop("salt")


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _rows(versions: DataFrame, key: str, text: str) -> DataFrame:
    """(row, blob, spread): all columns travel as one struct, so no name of theirs can clash."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return versions.select(F.struct(*[F.col(f"`{c}`") for c in versions.columns]).alias("row"), F.sha2(body, 256).alias("blob"), F.struct(F.col(f"`{key}`"), F.monotonically_increasing_id()).alias("spread"))


def secrets(versions: DataFrame, rules: tuple = RULES, ledger: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``versions`` with ``blob`` and ``found``: array of (start, o, end, kind).

    Null and empty texts have no findings.  Repeated rows and rows with a null key each get
    the findings of their own text.  Other columns are kept; where one of them is called
    ``blob`` or ``found``, ours is called ``blob_`` or ``found_``.  An empty table gives none.
    """
    found = per_blob(scan(versions, rules, ledger, key, text), rules)
    rows = to_paths(_rows(versions, key, text), found)
    none = F.array().cast("array<struct<start:bigint,o:int,end:bigint,kind:string>>")
    return rows.select("row.*", F.col("blob").alias(_free("blob", versions)), F.coalesce("found", none).alias(_free("found", versions)))


def _free(name: str, versions: DataFrame) -> str:
    while name in versions.columns:
        name += "_"
    return name


def redact(versions: DataFrame, rules: tuple = RULES, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``versions`` with each found span replaced by ``mark`` (overlapping spans by one).  Null texts
    stay null; all columns stay, whatever their names."""
    rows = secrets(versions, rules, None, key, text)
    found = F.col(_free("found", versions))
    body, start = F.col(f"`{text}`"), F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        piece = F.concat(F.substring(body, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))
        fresh = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(piece))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), fresh.alias("out"))

    done = F.aggregate(found, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(body, (acc["at"] + 1).cast("int"), 2147483647)))
    return rows.withColumn(text, F.when(F.size(found) > 0, done).otherwise(body)).select(*[F.col(f"`{c}`") for c in versions.columns])


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text of ``documents`` (null: empty), one row a row, repeated ones too.

    With ``tallyforge.secrets.ledger`` set in the session, that folder keeps the ledger: what an
    earlier run scanned isn't scanned again.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # the join back needs addresses only
    found = per_blob(scan(docs, ledger=spark.conf.get("tallyforge.secrets.ledger", None)))
    base = F.filter("found", lambda s: s["o"] < len(BASE))
    count = lambda k: F.size(F.filter("found", lambda s: s["o"] == k)).cast("long")
    found = found.select("blob", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("found")).alias("spans"))
    rows = to_paths(content_address(docs).select("doc_id", "blob", F.struct("doc_id", F.monotonically_increasing_id()).alias("spread")), found)
    zero = F.lit(0).cast("long")
    return rows.select("doc_id", *[F.coalesce(c, zero).alias(c) for c in ("n_assign", "n_access", "n_hex")], F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def _sql_kind(rule: Rule, order: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {order} AS o, '{rule.kind}' AS kind, regexp_extract_all(body, '{pattern}') AS w, regexp_extract_all(body, '{pattern}', {rule.group}) AS p,
    string_split_regex(body, '{pattern}') AS g, {rule.least} AS least FROM d"""


SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents), m AS ("
    + " UNION ALL ".join(_sql_kind(r, i) for i, r in enumerate(RULES))
    + """
), u AS (
  SELECT doc_id, o, kind, unnest(range(1, len(w) + 1)) AS i, w, p, g, least FROM m WHERE len(w) > 0
), e AS (
  SELECT doc_id, o, kind, least, length(p[i]) AS part, length(w[i]) AS n,
    sum(length(g[i]) + length(w[i])) OVER (PARTITION BY doc_id, o ORDER BY i) AS en FROM u
), s AS (
  SELECT doc_id, o, kind, kind || ':' || (en - n)::BIGINT || ':' || en::BIGINT AS span, (en - n) AS st FROM e WHERE part >= least
), a AS (
  SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
    coalesce(string_agg(span, ',' ORDER BY st, o) FILTER (o < 3), '') AS base, string_agg(span, ',' ORDER BY st, o) AS spans FROM s GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""
)
