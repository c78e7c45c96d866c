"""Intake of packages: names, structure, evidence, staleness, mappings and exact cover. Packages, routes and
files are told from the event table: a package is a user, a file an event's path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import records, relations
from tidewater.plans.common import Plan
from tidewater.plans.provenance import LOG_SQL, change_log
from tidewater.sources.tables import table

plan = Plan()
query = plan.query
QUERIES, ORACLES = plan.queries, plan.oracles

# What the names of routes, runs, decisions, comparisons and questions look like.
NAMES = {
    "route": "^r[0-9]{2}-[a-z0-9]+(-[a-z0-9]+)*$",
    "run": "^run-[0-9]{8}-[0-9]{4}-[a-z0-9]+(-[a-z0-9]+)*$",
    "decision": "^d[0-9]{2}-[a-z0-9]+(-[a-z0-9]+)*$",
    "comparison": "^c[0-9]{2}-[a-z0-9]+(-[a-z0-9]+)*$",
    "question": "^q[1-9][0-9]*$",
}

FOLDER_SQL = """folders AS (SELECT event_id, user_id AS package, event_type, CASE event_type WHEN 'view' THEN 'r' || lpad((user_id % 20)::VARCHAR, 2, '0') || '-' || CASE WHEN event_id % 7 = 0 THEN 'Bad Name' ELSE 'flow-model' END
    WHEN 'click' THEN 'run-' || strftime(ts, '%Y%m%d-%H%M') || '-check' WHEN 'purchase' THEN 'd' || lpad((event_id % 100)::VARCHAR, 2, '0') || '-keep' WHEN 'error' THEN 'c' || (event_id % 100)::VARCHAR || '-both' ELSE 'q' || (event_id % 4)::VARCHAR END AS name FROM events)"""


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name for each event, of the kind that its type stands for; some break the rules."""
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    text = lambda c, n: F.lpad(c.cast("string"), n, "0")
    route = F.concat(F.lit("r"), text(F.pmod("user_id", F.lit(20)), 2), F.lit("-"), F.when(F.pmod("event_id", F.lit(7)) == 0, "Bad Name").otherwise("flow-model"))
    run = F.concat(F.lit("run-"), F.date_format("ts", "yyyyMMdd-HHmm"), F.lit("-check"))
    decision = F.concat(F.lit("d"), text(F.pmod("event_id", F.lit(100)), 2), F.lit("-keep"))
    comparison = F.concat(F.lit("c"), F.pmod("event_id", F.lit(100)).cast("string"), F.lit("-both"))
    question = F.concat(F.lit("q"), F.pmod("event_id", F.lit(4)).cast("string"))
    name = F.when(kind == "view", route).when(kind == "click", run).when(kind == "purchase", decision).when(kind == "error", comparison).otherwise(question)
    return e.select("event_id", F.col("user_id").alias("package"), "event_type", name.alias("name"))


KINDS = {"view": "route", "click": "run", "purchase": "decision", "error": "comparison"}
RULE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN regexp_matches(name, '{NAMES[v]}')" for k, v in KINDS.items()) + f" ELSE regexp_matches(name, '{NAMES['question']}') END"
KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " ELSE 'question' END"


def named(rows: DataFrame) -> DataFrame:
    """rows with their kind and whether the name is as its kind asks for."""
    kind = reduce(lambda c, k: c.when(F.col("event_type") == k, KINDS[k]), list(KINDS)[1:], F.when(F.col("event_type") == "view", "route")).otherwise("question")
    fits = reduce(lambda c, k: c.when(F.col("kind") == k, F.col("name").rlike(NAMES[k])), list(NAMES)[1:], F.when(F.col("kind") == "route", F.col("name").rlike(NAMES["route"])))
    return rows.withColumn("kind", kind).withColumn("fits", fits)


@query(f"WITH {FOLDER_SQL} SELECT {KIND_SQL} AS kind, count(*) AS n, count(*) FILTER ({RULE_SQL}) AS fitting, min(CASE WHEN NOT {RULE_SQL} THEN name END) AS first_breach FROM folders GROUP BY 1")
def naming_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = named(folders(spark, sf_dir))
    return n.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("fits").alias("fitting"), F.min(F.when(~F.col("fits"), F.col("name"))).alias("first_breach"))


@query(f"""WITH {FOLDER_SQL}, g AS (SELECT package, count(DISTINCT name) FILTER (event_type = 'view') AS routes, count(*) FILTER (event_type = 'click') AS runs, count(*) FILTER (event_type NOT IN ('view', 'click', 'purchase', 'error')) AS questions, count(*) FILTER (NOT {RULE_SQL}) AS breaches FROM folders GROUP BY package)
SELECT package, problem FROM (SELECT package, unnest([CASE WHEN routes > 1 THEN 'several routes' END, CASE WHEN runs = 0 THEN 'no run' END, CASE WHEN questions = 0 THEN 'no question' END, CASE WHEN breaches > 5 THEN 'bad names' END]) AS problem FROM g) WHERE problem IS NOT NULL""")
def structure_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What packages lack or have too much of: one route, some run and question, few badly named folders."""
    of = lambda k: F.col("kind") == k
    g = named(folders(spark, sf_dir)).groupBy("package").agg(F.count_distinct(F.when(of("route"), F.col("name"))).alias("routes"), F.count_if(of("run")).alias("runs"), F.count_if(of("question")).alias("questions"), F.count_if(~F.col("fits")).alias("breaches"))
    found = F.array_compact(F.array(F.when(F.col("routes") > 1, "several routes"), F.when(F.col("runs") == 0, "no run"), F.when(F.col("questions") == 0, "no question"), F.when(F.col("breaches") > 5, "bad names")))
    return g.select("package", F.explode(found).alias("problem"))


@query("""WITH e AS (SELECT l_orderkey AS route, count(DISTINCT l_suppkey) AS sources, count(*) AS records FROM lineitem GROUP BY 1),
s AS (SELECT o_orderkey AS route, CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'rejected' ELSE 'draft' END AS status, coalesce(sources, 0) AS sources, coalesce(records, 0) AS records FROM orders LEFT JOIN e ON route = o_orderkey)
SELECT route, status, sources, records, CASE WHEN status = 'verified' AND sources < 2 THEN 'verified without a second source' WHEN status = 'rejected' AND sources >= 5 THEN 'rejected with much evidence' WHEN status = 'draft' AND records = 0 THEN 'draft without records' ELSE 'consistent' END AS finding FROM s""")
def status_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a route's status goes with its evidence: the distinct sources of its records, counted before they
    are joined to it."""
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("route")).agg(F.count_distinct("l_suppkey").alias("sources"), F.count(F.lit(1)).alias("records"))
    status = F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderstatus") == "O", "rejected").otherwise("draft")
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("route"), status.alias("status")).join(e, "route", "left").fillna(0, ["sources", "records"])
    finding = (
        F.when((F.col("status") == "verified") & (F.col("sources") < 2), "verified without a second source")
        .when((F.col("status") == "rejected") & (F.col("sources") >= 5), "rejected with much evidence")
        .when((F.col("status") == "draft") & (F.col("records") == 0), "draft without records")
        .otherwise("consistent")
    )
    return s.select("route", "status", "sources", "records", finding.alias("finding"))


@query("""WITH r AS (SELECT o_custkey AS package, o_orderkey AS route FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%'), b AS (SELECT c_custkey AS package, 'banned: ' || coalesce(string_agg(o_orderkey::VARCHAR, ', '), '') || ' end' AS section FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderkey % 3 > 0 GROUP BY c_custkey)
SELECT package, route FROM r JOIN b USING (package) WHERE strpos(replace(section, ':', ','), ', ' || route || ',') = 0 AND strpos(replace(replace(section, ':', ','), ' end', ','), ', ' || route || ',') = 0""")
def rejected_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected routes that the text of their package's ban section does not name."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("package"), F.col("o_orderkey").alias("route"), "o_orderpriority")
    listed = o.where("route % 3 > 0").groupBy("package").agg(F.listagg(F.col("route").cast("string"), F.lit(", ")).alias("text"))
    sections = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("package")).join(listed, "package", "left")
    sections = sections.select("package", F.concat(F.lit(", "), F.coalesce("text", F.lit("")), F.lit(",")).alias("section"))
    rows = o.where("o_orderpriority LIKE '1%'").join(sections, "package")
    return rows.where(~F.contains(F.col("section"), F.concat(F.lit(", "), F.col("route").cast("string"), F.lit(",")))).select("package", "route")


@query("""WITH f AS (SELECT source, doc_id, sha256(coalesce(text, '')) AS now, CASE WHEN doc_id % 50 = 7 AND source LIKE '%1' THEN 'other' ELSE sha256(coalesce(text, '')) END AS approved FROM documents),
m AS (SELECT source, count(*) AS files, sum(n_chars) AS now, sum(n_chars) + CASE WHEN source LIKE '%3' THEN 1 ELSE 0 END AS approved FROM documents GROUP BY source)
SELECT source, any_value(files) AS files, count(*) FILTER (f.now <> f.approved) AS changed, any_value(m.now <> m.approved) AS manifest_changed, CASE WHEN any_value(m.now <> m.approved) OR count(*) FILTER (f.now <> f.approved) > 0 THEN 'stale' ELSE 'valid' END AS approval FROM f JOIN m USING (source) GROUP BY source""")
def approval_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An approval holds while its tree's hash and its manifest are what was approved; else it is stale. How
    many files differ is told by their own hashes."""
    d = table(spark, sf_dir, "documents")
    now = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    changed = (F.pmod("doc_id", F.lit(50)) == 7) & F.col("source").endswith("1")
    files = d.select("source", "doc_id", now.alias("now"), F.when(changed, "other").otherwise(now).alias("approved"))
    trees = records.tree_hash(files, "source", "doc_id", "now").join(records.tree_hash(files, "source", "doc_id", "approved").select("source", F.col("tree").alias("was")), "source")
    differ = files.groupBy("source").agg(F.count_if(F.col("now") != F.col("approved")).alias("changed"))
    manifest = d.groupBy("source").agg(F.sum("n_chars").alias("sum")).withColumn("was_sum", F.col("sum") + F.when(F.col("source").endswith("3"), 1).otherwise(0))
    rows = trees.join(differ, "source").join(manifest, "source")
    other = F.col("sum") != F.col("was_sum")
    return rows.select("source", "files", "changed", other.alias("manifest_changed"), F.when(other | (F.col("tree") != F.col("was")), "stale").otherwise("valid").alias("approval"))


@query("""WITH p AS (SELECT o_custkey AS package, o_orderkey AS file, o_orderpriority AS kind, CASE WHEN o_custkey % 2 = 0 THEN 'strict' ELSE 'draft' END AS mode FROM orders), need AS (SELECT * FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('5-LOW')) v(kind)),
g AS (SELECT DISTINCT package, mode FROM p) SELECT package, need.kind AS missing, CASE WHEN mode = 'strict' THEN 'error' ELSE 'warning' END AS level FROM g CROSS JOIN need WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.package = g.package AND p.kind = need.kind)""")
def staging_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of files that a package lacks: an error where it is final, a warning where it is a draft."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("package"), F.col("o_orderpriority").alias("kind"))
    needed = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "5-LOW")))
    g = o.groupBy("package").agg(F.collect_set("kind").alias("kinds"))  # five kinds at most
    missing = F.explode(F.array_except(needed, F.col("kinds"))).alias("missing")
    return g.select("package", missing, F.when(F.pmod("package", F.lit(2)) == 0, "error").otherwise("warning").alias("level"))


@query("""WITH m AS (SELECT l_orderkey AS source, l_partkey AS destination FROM lineitem WHERE l_linenumber = 1), s AS (SELECT DISTINCT source FROM m), d AS (SELECT destination FROM m GROUP BY destination HAVING count(DISTINCT source) > 40)
SELECT 'several destinations' AS problem, count(*) AS n FROM (SELECT source FROM m GROUP BY source HAVING count(DISTINCT destination) > 1) UNION ALL SELECT 'crowded destination', count(*) FROM d
UNION ALL SELECT 'unknown source', count(*) FROM s ANTI JOIN orders ON source = o_orderkey UNION ALL SELECT 'unknown destination', count(DISTINCT destination) FROM m ANTI JOIN part ON destination = p_partkey UNION ALL SELECT 'not migrated', count(*) FROM orders ANTI JOIN s ON o_orderkey = source""")
def migration_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaches of a mapping from old to new places: one place for each, all there, nothing left out."""
    m = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("destination"))
    orders, parts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source")), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("destination"))
    several = lambda a, b, n: m.groupBy(a).agg(F.count_distinct(b).alias("k")).where(F.col("k") > n)
    found = {
        "several destinations": several("source", "destination", 1),
        "crowded destination": several("destination", "source", 40),
        "unknown source": m.select("source").distinct().join(orders, "source", "left_anti"),
        "unknown destination": m.select("destination").distinct().join(parts, "destination", "left_anti"),
        "not migrated": orders.join(m, "source", "left_anti"),
    }
    return reduce(DataFrame.unionByName, [rows.agg(F.lit(k).alias("problem"), F.count(F.lit(1)).alias("n")) for k, rows in found.items()])


# Fixed values of the plan: beginnings, and where what is below them goes.
CLASSIFICATION = [("source/", "official/"), ("runs/run-", "process/runs/"), ("decisions/", "process/decisions/"), ("decisions/9", "process/decisions/late/"), ("archive/", "unused/"), ("drafts/", "notes/"), ("legacy/", "../outside/")]
ALLOWED = ("official/", "process/", "notes/")
PLAN_SQL = "pl AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in CLASSIFICATION) + ") v(src, dst))"
ALLOWED_SQL = " OR ".join(f"starts_with(dst, '{a}')" for a in ALLOWED)


@query(f"""WITH {LOG_SQL}, {PLAN_SQL}, f AS (SELECT DISTINCT path FROM log WHERE status <> 'D'), h AS (SELECT path, count(src) AS rules, max_by(src, length(src)) AS src, max_by(dst, length(src)) AS dst FROM f LEFT JOIN pl ON starts_with(path, src) GROUP BY path),
u AS (SELECT src FROM pl WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.src = pl.src))
SELECT 'covered once' AS state, count(*) AS n FROM h WHERE rules = 1 AND ({ALLOWED_SQL}) UNION ALL SELECT 'covered twice', count(*) FROM h WHERE rules > 1 UNION ALL SELECT 'not covered', count(*) FROM h WHERE rules = 0
UNION ALL SELECT 'destination not allowed', count(*) FROM h WHERE rules > 0 AND NOT ({ALLOWED_SQL}) UNION ALL SELECT 'rule without files', count(*) FROM u""")
def exact_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a plan of beginnings covers the files that are there, each once, with allowed destinations
    only, and without rules that fit nothing. The plan is a short list."""
    f = change_log(spark, sf_dir).where("status <> 'D'").select("path").distinct()
    fits = [F.startswith(F.col("path"), F.lit(a)) for a, _ in CLASSIFICATION]
    longest = sorted(CLASSIFICATION, key=lambda r: (-len(r[0]), r[0]))
    first = lambda k: F.coalesce(*[F.when(F.startswith(F.col("path"), F.lit(r[0])), F.lit(r[k])) for r in longest])
    h = f.select("path", reduce(Column.__add__, [x.cast("int") for x in fits]).alias("rules"), first(0).alias("src"), first(1).alias("dst"))
    allowed = reduce(Column.__or__, [F.startswith(F.col("dst"), F.lit(a)) for a in ALLOWED])
    s = h.agg(
        F.count_if((F.col("rules") == 1) & allowed).alias("covered once"), F.count_if(F.col("rules") > 1).alias("covered twice"), F.count_if(F.col("rules") == 0).alias("not covered"),
        F.count_if((F.col("rules") > 0) & ~allowed).alias("destination not allowed"), (F.lit(len(CLASSIFICATION)) - F.count_distinct("src")).alias("rule without files"),
    )
    return s.unpivot([], s.columns, "state", "n")


FIELDS = ["title", "owner", "date", "state"]
CARD_SQL = """cards AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN [] ELSE ['title'] END || CASE WHEN user_id % 7 = 0 THEN [] ELSE ['owner'] END || ['date'] || CASE WHEN event_type = 'error' THEN [] ELSE ['state'] END AS keys FROM events)"""


@query(f"""WITH {CARD_SQL}, m AS (SELECT event_id, unnest({FIELDS}) AS field, keys FROM cards) SELECT field, count(*) AS records, count(*) FILTER (NOT list_contains(keys, field)) AS missing, min(CASE WHEN NOT list_contains(keys, field) THEN event_id END) AS first FROM m GROUP BY field""")
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a record's required fields are there with a value, read from its lines of keys and values."""
    e = table(spark, sf_dir, "events")
    line = lambda key, value, there: F.when(there, F.concat(F.lit(f"- {key}: "), value)).otherwise(F.lit(f"- {key}:"))
    card = F.concat_ws("\n", line("title", F.col("event_type"), F.pmod("event_id", F.lit(5)) != 0), line("owner", F.col("user_id").cast("string"), F.pmod("user_id", F.lit(7)) != 0), line("date", F.date_format("ts", "yyyy-MM-dd"), F.lit(True)), F.when(F.col("event_type") != "error", F.lit("- state: open")))
    fields = records.template_fields(e.withColumn("card", card), "event_id", "card")
    there = fields.select("event_id", F.explode(F.array(*map(F.lit, FIELDS))).alias("field"), "fields")
    missing = F.coalesce(F.try_element_at("fields", "field"), F.lit("")) == ""
    return there.groupBy("field").agg(F.count(F.lit(1)).alias("records"), F.count_if(missing).alias("missing"), F.min(F.when(missing, F.col("event_id"))).alias("first"))


@query("""WITH t AS (SELECT substr(html, 1, 40) AS head, html FROM pages WHERE page_id = (SELECT min(page_id) FROM pages)) SELECT page_id, coalesce(sha256(substr(p.html, 1, 40)) = sha256(t.head), FALSE) AS same_head, coalesce(md5(p.html) = md5(t.html), FALSE) AS equal FROM pages p, t""")
def template_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page is the template (the first one) byte for byte, and whether it begins like it."""
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    template = p.agg(F.min_by(F.struct(F.sha2(F.substring("html", 1, 40).cast("binary"), 256).alias("head"), F.sha2(F.col("html").cast("binary"), 256).alias("all")), "page_id").alias("t"))  # one row
    own = lambda c: F.sha2(c.cast("binary"), 256)
    rows = p.join(F.broadcast(template))
    return rows.select("page_id", F.coalesce(own(F.substring("html", 1, 40)) == F.col("t.head"), F.lit(False)).alias("same_head"), F.coalesce(own(F.col("html")) == F.col("t.all"), F.lit(False)).alias("equal"))


@query(f"""WITH {FOLDER_SQL}, d AS (SELECT package, count(*) AS folders, count(*) FILTER (NOT {RULE_SQL}) AS errors, count(DISTINCT name) FILTER (event_type NOT IN ('view', 'click', 'purchase', 'error')) AS questions, bool_or(name = 'q3') AS third FROM folders GROUP BY package)
SELECT package, folders, errors, questions, coalesce(third, FALSE) AND package % 2 = 0 AS undeclared, CASE WHEN errors > 5 OR (coalesce(third, FALSE) AND package % 2 = 0) THEN 'invalid' WHEN errors > 0 THEN 'warnings' ELSE 'valid' END AS result FROM d""")
def package_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package's result from its rules: breaches of names, and question folders that it does not declare
    (packages of even number declare no third one)."""
    n = named(folders(spark, sf_dir))
    g = n.groupBy("package").agg(F.count(F.lit(1)).alias("folders"), F.count_if(~F.col("fits")).alias("errors"), F.count_distinct(F.when(F.col("kind") == "question", F.col("name"))).alias("questions"), F.coalesce(F.bool_or(F.col("name") == "q3"), F.lit(False)).alias("third"))
    undeclared = F.col("third") & (F.pmod("package", F.lit(2)) == 0)
    result = F.when((F.col("errors") > 5) | undeclared, "invalid").when(F.col("errors") > 0, "warnings").otherwise("valid")
    return g.select("package", "folders", "errors", "questions", undeclared.alias("undeclared"), result.alias("result"))


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k, l_suppkey AS v FROM lineitem WHERE l_linenumber = 1), b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 2)
SELECT 'left' AS only_in, count(*) AS n FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'right', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def cover_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that one of two lists has and the other has not."""
    of = lambda n: table(spark, sf_dir, "lineitem").where(F.col("l_linenumber") == n).select("l_partkey", "l_suppkey").distinct()
    return relations.differences(of(1), of(2)).groupBy("only_in").agg(F.count(F.lit(1)).alias("n"))
