"""Records and files: coverage, order, hashes, rules, reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import records
from tidewater.plans.common import Plan
from tidewater.sources.tables import table

plan = Plan()
query = plan.query
QUERIES, ORACLES = plan.queries, plan.oracles


@query("""WITH twice AS (SELECT doc_id, 'duplicate' AS problem FROM labels GROUP BY doc_id HAVING count(*) > 1), missing AS (SELECT DISTINCT doc_id, 'missing' FROM labels ANTI JOIN documents USING (doc_id)), extra AS (SELECT DISTINCT doc_id, 'extra' FROM documents ANTI JOIN labels USING (doc_id))
SELECT * FROM twice UNION ALL SELECT * FROM missing UNION ALL SELECT * FROM extra""")
def provenance_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are declared twice, declared and not there, or there and not declared."""
    return records.coverage(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


MARKS = ["<html", "<head", "</head>", "<body", "</body>", "</html>"]


@query("SELECT page_id, coalesce(" + " AND ".join(f"length(html) - length(replace(html, '{m}', '')) = {len(m)}" for m in MARKS) + ", FALSE) AS once, coalesce(" + " AND ".join(f"strpos(html, '{a}') < strpos(html, '{b}')" for a, b in zip(MARKS, MARKS[1:])) + ", FALSE) AS ordered FROM pages")
def heading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page has its sections once and in order."""
    return records.sections_in_order(table(spark, sf_dir, "pages"), "page_id", "html", MARKS)


@query(r"""SELECT source, count(*) AS documents, count(*) FILTER (regexp_matches(text, '(TODO|TBD|lorem ipsum|xxx|\{\{)')) AS placeholders, count(*) FILTER (regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+')) AS addresses FROM documents GROUP BY source""")
def placeholder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("text").rlike(r"(TODO|TBD|lorem ipsum|xxx|\{\{)")).alias("placeholders"), F.count_if(F.col("text").rlike(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+")).alias("addresses"))


@query("SELECT sha256(text) AS sha, count(*) AS copies, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def duplicate_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


@query("""WITH e AS (SELECT source, doc_id AS p, doc_id::VARCHAR || chr(0) || sha256(coalesce(text, '')) || chr(0) AS e FROM documents),
a AS (SELECT source, p // 1024 AS p, sha256(string_agg(e, '' ORDER BY p)) AS e, count(*) AS n FROM e GROUP BY source, p // 1024),
b AS (SELECT source, p // 1024 AS p, sha256(string_agg(e, '' ORDER BY p)) AS e, sum(n) AS n FROM a GROUP BY source, p // 1024)
SELECT source, sum(n)::BIGINT AS files, sha256(string_agg(e, '' ORDER BY p)) AS tree FROM b GROUP BY source""")
def tree_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of each source's whole tree of documents; what was approved with another hash is stale."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))
    return records.tree_hash(d, "source", "doc_id", "sha")


LOG_SQL = """log AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'A' WHEN 'click' THEN 'M' WHEN 'error' THEN 'D' ELSE 'R' END AS status,
    (['source/', 'decisions/', 'runs/run-', 'drafts/', 'legacy/'])[1 + user_id % 5] || event_id AS path FROM events)"""


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "A").when(F.col("event_type") == "click", "M").when(F.col("event_type") == "error", "D").otherwise("R")
    folders = F.array(*map(F.lit, ("source/", "decisions/", "runs/run-", "drafts/", "legacy/")))
    return e.select("event_id", status.alias("status"), F.concat(folders[F.pmod("user_id", F.lit(5)).cast("int")], F.col("event_id").cast("string")).alias("path"))


@query(f"WITH {LOG_SQL} SELECT * FROM log WHERE status <> 'A' AND (starts_with(path, 'source/') OR starts_with(path, 'decisions/') OR starts_with(path, 'runs/run-') OR starts_with(path, 'legacy/')) AND NOT starts_with(path, 'legacy/1')")
def append_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes and deletions where only additions are allowed."""
    return records.rule_breaches(change_log(spark, sf_dir), "status", "path", ["source/", "decisions/", "runs/run-", "legacy/"], ["legacy/1"])


RULES = {"source/": "official", "source/1": "official-first", "runs/run-": "run", "decisions/": "decision"}


@query(f"""WITH {LOG_SQL}, c AS (SELECT CASE WHEN starts_with(path, 'source/1') THEN 'official-first' WHEN starts_with(path, 'runs/run-') THEN 'run' WHEN starts_with(path, 'decisions/') THEN 'decision' WHEN starts_with(path, 'source/') THEN 'official' END AS target FROM log) SELECT coalesce(target, '(none)') AS target, count(*) AS files FROM c GROUP BY 1""")
def classification_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the longest rule that fits; (none): not covered."""
    c = records.longest_prefix(change_log(spark, sf_dir), "path", RULES, "target")
    return c.groupBy(F.coalesce("target", F.lit("(none)")).alias("target")).agg(F.count(F.lit(1)).alias("files"))


@query("""WITH a AS (SELECT user_id, ts, CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'pending' END AS k FROM events)
SELECT user_id, coalesce(max_by(k, ts) FILTER (k IS NOT NULL), 'pending') AS state, count(k) AS changes FROM a GROUP BY user_id""")
def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each package's review stands after its last decision."""
    action = F.when(F.col("event_type") == "purchase", "approve").when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "signup", "submit")
    return records.review_state(table(spark, sf_dir, "events").withColumn("action", action), ["user_id"], ["ts"], "action")


@query("""SELECT (json_extract(props, '$.k')::INT % 10)::INT AS k, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.from_json("props", "k int").alias("p"), "value")
    return e.groupBy((F.col("p.k") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query(r"""WITH p AS (SELECT page_id, coalesce(regexp_extract(url, '://[^/]+/(.*)$', 1), '') AS path FROM pages) SELECT page_id, path, NOT regexp_matches(path, '^(/|[A-Za-z]:)|\\|(^|/)\.\.?(/|$)|//') AND length(path) > 0 AS safe FROM p""")
def safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.regexp_extract("url", "://[^/]+/(.*)$", 1), F.lit("")).alias("path"))
    return p.select("page_id", "path", records.safe_path("path").alias("safe"))
