"""Queries on rosters, sessions, fallbacks, page strategies and repairs, with their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import checks as C
from ..operators import glyphs as G
from ..sources import files
from ..sources.views import Relations, oracle
from ..streaming import runs, tasks
from .check_queries import TASKS
from .registry import query


@query(f"""WITH t AS ({TASKS}), b AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM t WINDOW w AS (PARTITION BY task ORDER BY ts)),
s AS (SELECT *, sum(n) OVER (PARTITION BY task ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM b)
SELECT task, CAST(min(ts) AS TIMESTAMP) AS start, CAST(max(ts) + INTERVAL 6 HOUR AS TIMESTAMP) AS "end", count(*) AS attempts FROM s GROUP BY task, k""")
def task_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a task's attempts without a gap of over six hours."""
    return tasks.sessions(Relations(spark, sf_dir).sql(TASKS), "6 hours")


@query(f"SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, kind, count(*) AS attempts FROM ({TASKS}) GROUP BY 1, 2")
def task_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.rates(Relations(spark, sf_dir).sql(TASKS))


#: Events of runs of a user's tasks: added, asked for, ended and resumed in some order, days apart.
RUN_EVENTS = """SELECT concat('run-', CAST(user_id AS VARCHAR(9))) AS run, event_id AS seq, ts, CASE WHEN event_id % 11 <= 2 THEN 'add' WHEN event_id % 11 <= 5 THEN 'ask' WHEN event_id % 11 <= 7 THEN 'accept' WHEN event_id % 11 <= 9 THEN 'fail' ELSE 'resume' END AS kind,
 CASE WHEN event_id % 11 BETWEEN 3 AND 5 THEN NULL WHEN event_id % 11 = 10 AND event_id % 2 = 0 THEN NULL ELSE concat('t', CAST(CAST(floor(event_id / 11) AS BIGINT) % 4 AS VARCHAR(9))) END AS task,
 CASE WHEN event_id % 11 BETWEEN 3 AND 5 THEN CAST(event_id % 3 + 1 AS VARCHAR(9)) WHEN event_id % 11 = 8 THEN 'transient' WHEN event_id % 11 = 9 THEN CASE event_id % 3 WHEN 0 THEN 'quota' ELSE 'invalid' END END AS value FROM events WHERE user_id IS NOT NULL"""
_PATIENCE = 4 * 24 * 3_600_000
# A recursion over a run's events whose state is a list of its tasks: s status, a attempts, m most, b begun.
_OVER = f"x.s = 'inflight' AND x.b + {_PATIENCE} <= e.ms"


@query(f"""WITH RECURSIVE v AS ({RUN_EVENTS}), n AS (SELECT *, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY run ORDER BY ts, seq) AS k FROM v),
r AS (SELECT run, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS error, CAST(NULL AS VARCHAR) AS paused, '' AS jobs, CAST([] AS STRUCT(n VARCHAR, s VARCHAR, a BIGINT, m BIGINT, b BIGINT)[]) AS t FROM (SELECT DISTINCT run FROM n)
UNION ALL SELECT run, k, seq, error, paused, jobs, t FROM (
 SELECT *, CASE WHEN kind = 'resume' THEN CASE WHEN task IS NOT NULL AND coalesce(own.s, '') <> 'exhausted' THEN 'retry_not_exhausted' WHEN len(list_filter(t3, lambda x: x.s = 'exhausted')) > 0 THEN 'retries_exhausted' END
   WHEN kind IN ('accept', 'fail') AND coalesce(own.s, '') <> 'inflight' THEN 'task_not_inflight' END AS error,
  CASE WHEN kind = 'resume' AND (task IS NULL OR own.s = 'exhausted') AND len(list_filter(t3, lambda x: x.s = 'exhausted')) = 0 THEN NULL
   WHEN kind = 'fail' AND own.s = 'inflight' THEN CASE WHEN own.a >= own.m THEN 'retries_exhausted' WHEN value = 'quota' THEN value ELSE p1 END ELSE p1 END AS paused,
  array_to_string(list_transform(list_filter(t3, lambda x: x.s = 'inflight' AND NOT list_contains(list_transform(list_filter(t1, lambda y: y.s = 'inflight'), lambda y: y.n), x.n)), lambda x: x.n || '#' || x.a), ',') AS jobs, t3 AS t FROM (
  SELECT *, CASE kind WHEN 'add' THEN CASE WHEN own IS NULL THEN list_append(t1, {{'n': task, 's': 'pending', 'a': 0, 'm': 3, 'b': 0}}) ELSE t1 END
   WHEN 'ask' THEN list_transform(t1, lambda x: CASE WHEN list_contains(given, x.n) THEN {{'n': x.n, 's': 'inflight', 'a': x.a + 1, 'm': x.m, 'b': ms}} ELSE x END)
   WHEN 'accept' THEN list_transform(t1, lambda x: CASE WHEN x.n = task AND x.s = 'inflight' THEN {{'n': x.n, 's': 'accepted', 'a': x.a, 'm': x.m, 'b': x.b}} ELSE x END)
   WHEN 'fail' THEN list_transform(t1, lambda x: CASE WHEN x.n = task AND x.s = 'inflight' THEN {{'n': x.n, 's': CASE WHEN x.a >= x.m THEN 'exhausted' ELSE 'retry' END, 'a': x.a, 'm': x.m, 'b': x.b}} ELSE x END)
   ELSE list_transform(t1, lambda x: CASE WHEN x.n = task AND x.s = 'exhausted' THEN {{'n': x.n, 's': 'retry', 'a': x.a, 'm': x.m + 1, 'b': x.b}} ELSE x END) END AS t3 FROM (
   SELECT *, list_filter(t1, lambda x: x.n = task)[1] AS own, CASE WHEN p1 IS NULL THEN list_transform(list_filter(t1, lambda x: x.s IN ('pending', 'retry')), lambda x: x.n)[1:greatest(0, least(CAST(CASE WHEN kind = 'ask' THEN value END AS BIGINT), 3 - len(list_filter(t1, lambda x: x.s = 'inflight'))))] ELSE [] END AS given FROM (
    SELECT e.run, e.k, e.seq, e.ms, e.kind, e.task, e.value,
     list_transform(r.t, lambda x: CASE WHEN {_OVER} THEN {{'n': x.n, 's': CASE WHEN x.a >= x.m THEN 'exhausted' ELSE 'retry' END, 'a': x.a, 'm': x.m, 'b': x.b}} ELSE x END) AS t1,
     coalesce(list_sort(list_transform(list_filter(list_transform(r.t, lambda x, i: {{'b': x.b, 'i': i, 's': x.s, 'x': x.a >= x.m}}), lambda x: {_OVER}), lambda x: {{'b': x.b, 'i': x.i, 'p': CASE WHEN x.x THEN 'retries_exhausted' ELSE 'interrupted' END}}))[-1].p, r.paused) AS p1
    FROM r JOIN n e ON e.run = r.run AND e.k = r.k + 1)))))
SELECT run, seq, error, paused, jobs, array_to_string(list_transform(t, lambda x: x.n || '=' || x.s || '/' || x.a), ',') AS tasks FROM r WHERE k > 0""")
def run_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every event of a run does: what it gives out, what pauses, the state of all tasks after it."""
    return runs.run_log(Relations(spark, sf_dir).sql(RUN_EVENTS), runs.Profile(patience=_PATIENCE))


@query(oracle("""SELECT page, box, 'primary' AS finder FROM boxes WHERE kind = 'table' UNION ALL
SELECT page, box, 'fallback' FROM boxes WHERE kind = 'figure' AND page NOT IN (SELECT page FROM boxes WHERE kind = 'table')""", "boxes"))
def table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = Relations(spark, sf_dir).view("boxes")
    kind = lambda k: boxes.where(F.col("kind") == k).select("page", "box")
    return files.table_scan(kind("table"), kind("figure"), ["page"])


@query("""SELECT 'output' AS "column", 'out-' || n_regionkey AS value FROM nation GROUP BY n_regionkey HAVING count(*) > 1
UNION ALL SELECT 'id_prefix', left(n_name, 1) FROM nation GROUP BY left(n_name, 1) HAVING count(*) > 1""")
def roster_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Relations(spark, sf_dir).table("nation").select(
        F.col("n_name").alias("name"), F.concat(F.lit("out-"), "n_regionkey").alias("output"), F.concat(F.lit("p-"), "n_name").alias("prompt"), F.substring("n_name", 1, 1).alias("id_prefix")
    )
    return files.roster_errors(files.roster(rows))


@query(oracle(r"""SELECT paper_id, page, CASE WHEN trim(text) = '' THEN TRUE WHEN regexp_matches(trim(regexp_replace(text, '\s+', ' ', 'g')), '(?i)^(?:table|figure|fig\.) (?:[A-Z]\.?)?\d+(?:\.\d+)?[A-Za-z]?(?: ?:|$)') THEN TRUE
 WHEN len(l) <= 3 AND len(list_filter(l, lambda x: length(x) >= 90)) = 0 THEN TRUE WHEN length(s) < 250 AND regexp_matches(s, '(?i)\b(?:table|figure|appendix|survey|question|note)\b') THEN TRUE
 WHEN length(s) < 250 AND length(s) - length(replace(s, '%', '')) >= 2 THEN TRUE ELSE FALSE END AS sparse
FROM (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM page_records WHERE text IS NOT NULL)""", "page_records"))
def sparse_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = Relations(spark, sf_dir).view("page_records").where("text is not null")
    return pages.select("paper_id", "page", P.sparse_page(F.col("text")).alias("sparse"))


@query("""SELECT box, CASE WHEN two THEN 'native_content_order_two_column' WHEN fidelity THEN 'native_content_order_font_fidelity' WHEN land AND sim < 0.9 THEN 'native_content_order_landscape' ELSE 'coordinate_sorted' END AS strategy
FROM (SELECT l_orderkey * 10 + l_linenumber AS box, l_partkey % 3 = 0 AS two, l_partkey % 5 = 0 AS fidelity, l_partkey % 7 = 0 AS land, l_quantity / 50 AS sim FROM lineitem)""")
def text_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey")
    out = P.text_strategy(part % 3 == 0, part % 5 == 0, part % 7 == 0, F.col("l_quantity") / 50)
    return Relations(spark, sf_dir).table("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("box"), out.alias("strategy"))


@query("""SELECT paper, accent || letter AS find, CASE letter WHEN 'e' THEN CASE accent WHEN '´' THEN 'é' ELSE 'è' END ELSE CASE accent WHEN '´' THEN 'á' ELSE 'à' END END AS put FROM (
SELECT s_nationkey AS paper, CASE s_suppkey % 2 WHEN 0 THEN '´' ELSE '`' END AS accent, CASE s_suppkey % 3 WHEN 0 THEN 'e' ELSE 'a' END AS letter, s_suppkey % 10 < 8 AS fits FROM supplier)
GROUP BY paper, accent, letter HAVING bool_and(fits)""")
def accent_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    box = lambda shift: F.struct((F.lit(0.0) + shift).alias("x0"), (F.lit(5.0) + shift).alias("x1"), F.lit(9.0).alias("y"), F.lit(10.0).alias("size"), F.lit("F").alias("font"))
    pairs = Relations(spark, sf_dir).table("supplier").select(
        F.col("s_nationkey").alias("paper"), F.when(k % 2 == 0, "´").otherwise("`").alias("accent"), F.when(k % 3 == 0, "e").otherwise("a").alias("letter"),
        box(F.lit(0.0)).alias("a"), box(F.when(k % 10 < 8, 1.0).otherwise(4.0)).alias("b"),
    )
    return G.accent_repairs(pairs, ["paper"])


@query("""SELECT 'issue' AS kind, e.event_id AS id, CASE WHEN e.event_type = 'view' THEN CASE WHEN e.user_id % 3 = 0 THEN 'parser_artifact' ELSE 'manuscript_issue' END
 WHEN e.event_type = 'click' THEN CASE WHEN e.user_id % 3 = 1 THEN 'bibliography_maintenance' ELSE 'reference_integrity' END WHEN e.event_type = 'signup' THEN 'copyedit_issue' ELSE 'manuscript_issue' END AS issue_class FROM events e WHERE e.event_id % 4 <> 0
UNION ALL SELECT 'issue', event_id, 'cannot_verify' FROM events WHERE event_id % 4 = 0""")
def issue_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that findings without an explicit one get from category, assessment and their rater's role."""
    c = F.col
    role = F.when(c("event_type") == "view", "crossref").when(c("event_type") == "click", "reference").when(c("event_type") == "signup", "copyedit").otherwise("standard")
    category = F.element_at(F.array(F.lit("Parser noise"), F.lit("outdated link"), F.lit("other")), c("user_id").cast("int") % 3 + 1)
    out = P.issue_class(F.lit(None).cast("string"), category, F.when(c("event_id") % 4 == 0, "cannot_verify").otherwise("no"), role)
    return Relations(spark, sf_dir).table("events").select(F.lit("issue").alias("kind"), c("event_id").alias("id"), out.alias("issue_class"))


@query("""SELECT r.name, coalesce(o.n, 0) AS findings, CASE WHEN o.n IS NULL THEN 'no output' ELSE 'ok' END AS status, coalesce(s.reason, 'selected by rater applicability routing') AS reason
FROM (SELECT 'r' || n_nationkey AS name, n_nationkey FROM nation) r LEFT JOIN (SELECT 'r' || (user_id % 30) AS name, count(*) AS n FROM events WHERE user_id % 3 = 0 GROUP BY 1) o USING (name)
LEFT JOIN (SELECT 'r' || n_nationkey AS name, n_name AS reason FROM nation WHERE n_nationkey % 2 = 0) s USING (name)""")
def roster_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = Relations(spark, sf_dir)
    nation = data.table("nation").select(F.concat(F.lit("r"), "n_nationkey").alias("name"), "n_nationkey", F.col("n_name").alias("reason"))
    outputs = data.table("events").where("user_id % 3 = 0").select(F.concat(F.lit("r"), F.col("user_id") % 30).alias("name"))
    return C.roster_status(nation.select("name"), outputs, nation.where("n_nationkey % 2 = 0").select("name", "reason"))
