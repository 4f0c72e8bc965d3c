"""Queries on runs: layout, repairs, resumption, derivation, choices, leases, selections, with their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks as C
from ..operators import lifecycle as Y
from ..sources.views import Relations, oracle
from .registry import query


@query("""SELECT paper_id, part, replace(path, '{paper}', paper_id) AS path FROM (SELECT DISTINCT 'paper-' || (p_partkey % 50) AS paper_id FROM part), (VALUES ('parsed', 'work/{paper}/parsed'), ('prompts', 'work/{paper}/prompts'),
 ('reviews', 'work/{paper}/reviews'), ('editor', 'work/{paper}/editor'), ('selection', 'work/{paper}/selection'), ('logs', 'work/{paper}/logs'), ('outputs', 'outputs/{paper}'), ('bundle', 'work/{paper}/editor/normalized_bundle.json'),
 ('editor_prompt', 'work/{paper}/prompts/editor_report.txt'), ('editor_input', 'work/{paper}/editor/editor_input.md'), ('report', 'outputs/{paper}/report.md'), ('run_manifest', 'work/{paper}/run_manifest.json')) v(part, path)""")
def run_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = Relations(spark, sf_dir).table("part").select(F.concat(F.lit("paper-"), F.col("p_partkey") % 50).alias("paper_id"))
    return Y.layout(papers)


PATHS = """SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/srv/run/' WHEN 1 THEN '/srv/run' ELSE 'C:\\run' END AS root,
 CASE page_id % 5 WHEN 0 THEN '/srv/run/work/a.json' WHEN 1 THEN '/srv/run' WHEN 2 THEN 'C:\\run\\work\\b.json' WHEN 3 THEN '/srv/runner/c' ELSE 'work/d' END AS path FROM pages"""


@query(f"""SELECT page_id, CASE WHEN p = r THEN '.' WHEN starts_with(p, r || '/') THEN substring(p, length(r) + 2) ELSE p END AS path
FROM (SELECT page_id, replace(path, '\\', '/') AS p, rtrim(replace(root, '\\', '/'), '/') AS r FROM ({PATHS.replace(chr(92) * 2, chr(92))}))""".replace("'\\'", "chr(92)"))
def portable_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Relations(spark, sf_dir).sql(PATHS.replace("\\", "\\\\"))
    return rows.select("page_id", Y.portable(F.col("path"), F.col("root")).alias("path"))


REQUESTS = """SELECT o_custkey AS run, o_orderkey AS place, CASE o_orderkey % 6 WHEN 0 THEN 'intake' WHEN 1 THEN 'claims' WHEN 2 THEN 'numbers' WHEN 3 THEN 'editor' WHEN 4 THEN 'Bad stage' ELSE 'claims' END AS stage, CAST(o_custkey % 4 - 1 AS INT) AS cap FROM orders"""


@query(f"""WITH RECURSIVE q AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY place) AS k FROM ({REQUESTS})),
w AS (SELECT run, place, stage, cap, k, stage <> 'Bad stage' AND cap > 0 AS granted, CASE WHEN stage = 'Bad stage' OR cap < 0 THEN [] ELSE [stage] END AS seen, CASE WHEN stage <> 'Bad stage' AND cap > 0 THEN 1 ELSE 0 END AS used FROM q WHERE k = 1
 UNION ALL SELECT q.run, q.place, q.stage, q.cap, q.k, q.stage <> 'Bad stage' AND NOT list_contains(seen, q.stage) AND used < q.cap, CASE WHEN q.stage = 'Bad stage' OR q.cap < 0 OR list_contains(seen, q.stage) THEN seen ELSE list_append(seen, q.stage) END,
  used + CASE WHEN q.stage <> 'Bad stage' AND NOT list_contains(seen, q.stage) AND used < q.cap THEN 1 ELSE 0 END FROM w JOIN q ON q.run = w.run AND q.k = w.k + 1),
b AS (SELECT *, lag(seen, 1, []) OVER (PARTITION BY run ORDER BY k) AS before FROM w)
SELECT run, place, stage, CASE WHEN granted THEN used END AS number, CASE WHEN granted THEN NULL WHEN stage = 'Bad stage' OR cap < 0 THEN 'invalid' WHEN list_contains(before, stage) THEN 'stage repaired before' ELSE 'cap reached' END AS refused FROM b""")
def repair_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs that runs ask for, one a stage and so many a run."""
    return Y.repair_grants(Relations(spark, sf_dir).sql(REQUESTS)).select("run", "place", "stage", "number", "refused")


RUNS = "SELECT DISTINCT o_custkey AS run, concat('s', CAST(o_custkey % 5 AS VARCHAR(9))) AS settings FROM orders"
CHECKPOINTS = "SELECT DISTINCT o_custkey AS run, CASE WHEN o_custkey % 7 = 0 THEN 1 ELSE 2 END AS format, concat('s', CAST(o_custkey % 5 + CASE WHEN o_custkey % 9 = 0 THEN 1 ELSE 0 END AS VARCHAR(9))) AS settings FROM orders WHERE o_custkey % 11 <> 0"
SAVED = "SELECT o_custkey AS run, concat('f', CAST(o_orderkey AS VARCHAR(20))) AS path, CAST(o_orderkey % 97 AS VARCHAR(9)) AS sha256 FROM orders WHERE o_custkey % 11 <> 0 AND o_orderkey % 53 <> 0"
NOW = "SELECT o_custkey AS run, concat('f', CAST(o_orderkey AS VARCHAR(20))) AS path, CAST(o_orderkey % 97 + CASE WHEN o_orderkey % 59 = 0 THEN 1 ELSE 0 END AS VARCHAR(9)) AS sha256 FROM orders WHERE o_custkey % 11 <> 0 AND o_orderkey % 61 <> 0"
OUTPUTS = "SELECT o_custkey AS run, concat('r', CAST(o_orderkey AS VARCHAR(20))) AS name, CAST(o_orderkey % 89 AS VARCHAR(9)) AS sha256 FROM orders WHERE o_orderkey % 67 <> 0"
ACCEPTED = "SELECT o_custkey AS run, concat('r', CAST(o_orderkey AS VARCHAR(20))) AS name, CAST(o_orderkey % 89 + CASE WHEN o_orderkey % 71 = 0 THEN 1 ELSE 0 END AS VARCHAR(9)) AS sha256 FROM orders WHERE o_orderkey % 2 = 0"
_RESUME = f"""runs AS ({RUNS}), k AS ({CHECKPOINTS}), s AS ({SAVED}), n AS ({NOW}), o AS ({OUTPUTS}), a AS ({ACCEPTED}), e AS (
SELECT run, 'no checkpoint' AS error, NULL AS item FROM runs WHERE run NOT IN (SELECT run FROM k) UNION ALL SELECT run, 'older policy', CAST(format AS VARCHAR) FROM k WHERE format <> 2
UNION ALL SELECT k.run, 'settings differ', NULL FROM k JOIN runs ON k.run = runs.run WHERE k.settings <> runs.settings
UNION ALL SELECT coalesce(s.run, n.run), CASE WHEN s.run IS NULL THEN 'file added' WHEN n.run IS NULL THEN 'file removed' ELSE 'file changed' END, coalesce(s.path, n.path) FROM s FULL JOIN n ON s.run = n.run AND s.path = n.path WHERE s.sha256 IS DISTINCT FROM n.sha256
UNION ALL SELECT a.run, CASE WHEN o.run IS NULL THEN 'unknown accepted' ELSE 'accepted output changed' END, a.name FROM a LEFT JOIN o ON a.run = o.run AND a.name = o.name WHERE o.sha256 IS NULL OR o.sha256 <> a.sha256)"""


def _resume(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    data = Relations(spark, sf_dir)
    accepted, outputs = data.sql(ACCEPTED), data.sql(OUTPUTS)
    return Y.resume_errors(data.sql(CHECKPOINTS), data.sql(RUNS), data.sql(SAVED), data.sql(NOW), accepted, outputs), outputs, accepted


@query(f"WITH {_RESUME} SELECT DISTINCT run, error, item FROM e")
def resume_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resume(spark, sf_dir)[0]


@query(f"WITH {_RESUME} SELECT o.run, o.name FROM o LEFT JOIN a ON o.run = a.run AND o.name = a.name WHERE a.run IS NULL AND o.run NOT IN (SELECT run FROM e)")
def remaining_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What resumed runs still have to do."""
    errors, outputs, accepted = _resume(spark, sf_dir)
    return Y.remaining(outputs, accepted, errors)


DERIVED = """SELECT concat(CASE WHEN c_custkey % 17 = 0 THEN '/runs/' WHEN c_custkey % 16 = 0 THEN '/runs' ELSE '/derived/' END, CAST(c_custkey AS VARCHAR(20))) AS child, CASE WHEN c_custkey % 19 = 0 THEN 'a/b' WHEN c_custkey % 23 = 0 THEN '..' ELSE 'paper' END AS paper_id,
 CASE WHEN c_custkey % 17 = 0 THEN '/runs' WHEN c_custkey % 16 = 0 THEN concat('/runs', CAST(c_custkey AS VARCHAR(20)), '/x') ELSE '/runs/other' END AS parent, CASE WHEN c_custkey % 5 = 0 THEN 'failed' ELSE 'complete' END AS status, c_custkey % 7 <> 0 AS has_receipts, c_custkey % 29 = 0 AS child_exists,
 CAST(c_custkey % 10 - 1 AS INT) AS repairs, CAST(c_nationkey AS VARCHAR(9)) AS manifest_settings, CAST(CASE WHEN c_custkey % 31 = 0 THEN -1 ELSE c_nationkey END AS VARCHAR(9)) AS accepted_settings, 'x' AS manifest_sha256, CASE WHEN c_custkey % 37 = 0 THEN 'y' ELSE 'x' END AS accepted_sha256, 'x' AS copied_sha256 FROM customer"""
ROSTERS = f"SELECT child, n_name AS name, TRUE AS expected, length(child) % 7 <> 0 OR n_nationkey <> 3 AS accepted FROM ({DERIVED}) d JOIN nation ON n_nationkey < 5"


@query(f"""SELECT child, errors FROM (SELECT child, array_to_string(list_filter([CASE WHEN paper_id IN ('a/b', '..') THEN 'paper' END, CASE WHEN starts_with(child || '/', parent || '/') OR starts_with(parent || '/', child || '/') THEN 'nested' END,
 CASE WHEN child_exists THEN 'exists' END, CASE WHEN repairs < 0 THEN 'repairs' END, CASE WHEN status <> 'complete' OR NOT has_receipts THEN 'parent unfinished' END, CASE WHEN length(child) % 7 = 0 THEN 'roster' END,
 CASE WHEN manifest_settings <> accepted_settings THEN 'settings' END, CASE WHEN manifest_sha256 <> accepted_sha256 THEN 'source' END, CASE WHEN copied_sha256 <> accepted_sha256 THEN 'changed while copying' END], lambda x: x IS NOT NULL), ',') AS errors FROM ({DERIVED})) WHERE errors <> ''""")
def derivation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = Relations(spark, sf_dir)
    return Y.derivation_errors(data.sql(DERIVED), data.sql(ROSTERS))


CHOICES = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'one' WHEN 1 THEN 'two' WHEN 2 THEN 'odd' END AS explicit, CASE user_id % 4 WHEN 0 THEN 'one' WHEN 1 THEN 'two' WHEN 2 THEN CASE WHEN event_id % 9 = 0 THEN 'old' END END AS saved,
 CASE event_type WHEN 'view' THEN 'two' WHEN 'click' THEN 'new' END AS preference FROM events"""


@query(f"""SELECT event_id, CASE WHEN error IS NULL THEN coalesce(saved, explicit, preference, 'one') END AS choice, CASE WHEN error IS NOT NULL THEN NULL WHEN explicit IS NOT NULL THEN 'explicit choice' WHEN saved IS NOT NULL THEN 'saved run' WHEN preference IS NOT NULL THEN 'preference' ELSE 'default' END AS origin, error
FROM (SELECT *, CASE WHEN explicit = 'odd' THEN 'unknown explicit choice' WHEN saved = 'old' THEN 'unknown saved choice' WHEN saved <> explicit THEN 'differs from saved run' WHEN saved IS NULL AND explicit IS NULL AND preference = 'new' THEN 'unknown preference' END AS error FROM ({CHOICES}))""")
def resolved_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = Relations(spark, sf_dir).sql(CHOICES)
    return rows.select("event_id", Y.resolved_choice(c("explicit"), c("saved"), c("preference"), ("one", "two"), "one").alias("r")).select("event_id", "r.*")


LEASES = "SELECT user_id AS run, concat('h', CAST(event_id AS VARCHAR(20))) AS holder, ts AS began, CASE WHEN event_id % 50 = 0 THEN ts + INTERVAL 3 DAY WHEN event_id % 997 = 0 THEN NULL ELSE ts + INTERVAL 1 MINUTE END AS ended FROM events"


@query(f"""WITH l AS ({LEASES}) SELECT run, holder, CAST(began AS TIMESTAMP) AS began, other FROM (SELECT *, arg_max(holder, (coalesce(ended, TIMESTAMP '9999-12-31'), holder)) OVER w AS other, max(coalesce(ended, TIMESTAMP '9999-12-31')) OVER w AS last FROM l
 WINDOW w AS (PARTITION BY run ORDER BY began, holder ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE last > began""")
def lease_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.lease_conflicts(Relations(spark, sf_dir).sql(LEASES))


CHOSEN = "SELECT conv_id AS packet, concat('paper-', CAST(CAST(floor(conv_id / 5) AS BIGINT) AS VARCHAR(20))) AS paper_id, conv_id * 100 + CASE WHEN turn = 3 THEN 2 ELSE turn END + CASE WHEN conv_id % 6 = 0 THEN 50 ELSE 0 END AS id FROM conversations WHERE turn < 2 + conv_id % 7"


@query(oracle(f"""WITH chosen AS ({CHOSEN}), j AS (SELECT c.*, f.severity FROM chosen c LEFT JOIN findings f ON f.paper_id = c.paper_id AND f.id = c.id)
SELECT packet, errors FROM (SELECT packet, array_to_string(list_filter([CASE WHEN count(*) > 5 THEN 'number' END, CASE WHEN count(DISTINCT id) < count(*) THEN 'repeated' END, CASE WHEN bool_or(severity IS NULL) THEN 'unknown' END,
 CASE WHEN bool_or(severity = 'low') THEN 'minor' END], lambda x: x IS NOT NULL), ',') AS errors FROM j GROUP BY 1) WHERE errors <> ''""", "findings"))
def selection_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preselections of findings for a second look."""
    data = Relations(spark, sf_dir)
    return Y.selection_guard(data.sql(CHOSEN), data.view("findings"))


@query("""SELECT event_id, ts + INTERVAL 1 SECOND * (user_id - 20) >= ts AS accepted FROM events""")
def fresh_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs written up to twenty seconds before their attempt began, or after."""
    rows = Relations(spark, sf_dir).sql("SELECT event_id, ts AS started, ts + INTERVAL 1 SECOND * (user_id - 20) AS modified FROM events")
    return C.fresh(rows).select("event_id", "accepted")


@query("""SELECT path FROM (SELECT 'tables/table_' || p_partkey || '.csv' AS path, p_partkey AS k FROM part UNION ALL SELECT 'tables/table.csv', 0 UNION ALL SELECT 'figures/figure_1.png', 0) WHERE k % 3 = 1""")
def stale_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered tables that are not to be kept."""
    part = Relations(spark, sf_dir).table("part")
    path = F.concat(F.lit("tables/table_"), F.col("p_partkey"), F.lit(".csv")).alias("path")
    listing = part.select(path).union(spark.createDataFrame([("tables/table.csv",), ("figures/figure_1.png",)], "path string"))
    return C.stale(listing, part.where("p_partkey % 3 <> 1").select(path), "table")
