"""Queries on findings and benchmarks, with their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import benchmark as B
from ..operators import ranking as R
from ..sources.views import Relations, oracle
from .registry import query

SCORE = """CASE severity WHEN 'high' THEN 60 WHEN 'medium' THEN 35 WHEN 'low' THEN 10 ELSE 0 END + CASE confidence WHEN 'high' THEN 15 WHEN 'medium' THEN 8 ELSE 0 END
+ CASE issue_type WHEN 'manuscript_issue' THEN 15 WHEN 'reference_integrity' THEN 4 WHEN 'bibliography_maintenance' THEN -12 WHEN 'copyedit_issue' THEN -45
  WHEN 'parser_artifact' THEN CASE WHEN severity = 'high' THEN 10 ELSE -18 END WHEN 'cannot_verify' THEN CASE WHEN severity = 'high' THEN 12 ELSE -5 END ELSE 0 END"""
ROUTE = """CASE WHEN issue_type = 'copyedit_issue' THEN 'grammar_appendix' WHEN issue_type = 'parser_artifact' THEN 'parser_appendix'
WHEN issue_type = 'cannot_verify' OR assessment = 'cannot_verify' THEN 'cannot_verify' WHEN issue_type = 'reference_integrity' THEN 'reference_integrity'
WHEN issue_type = 'bibliography_maintenance' THEN 'bibliography_appendix' WHEN rater = 'literature' THEN 'literature'
WHEN issue_type = 'manuscript_issue' AND confidence = 'high' AND score >= 55 THEN 'highest_priority' ELSE 'additional' END"""
SCORED = f"scored AS (SELECT *, {SCORE} AS score FROM findings), routed AS (SELECT *, {ROUTE} AS section FROM scored)"


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    found = Relations(spark, sf_dir).view("findings")
    scored = found.withColumn("score", R.priority(c("severity"), c("confidence"), c("issue_type")))
    return scored.withColumn("section", R.route(c("issue_type"), c("assessment"), c("confidence"), c("score"), c("rater") == "literature"))


@query(oracle(f"WITH {SCORED} SELECT paper_id, id, score, section FROM routed", "findings"))
def finding_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("paper_id", "id", "score", "section")


@query(oracle(f"""WITH {SCORED}, k AS (SELECT paper_id, id, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, id) AS k FROM routed WHERE section = 'highest_priority')
SELECT r.paper_id, r.id, score, CASE WHEN section = 'highest_priority' AND k > 8 THEN 'additional' ELSE section END AS section FROM routed r LEFT JOIN k USING (paper_id, id)""", "findings"))
def top_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cap_top(_routed(spark, sf_dir), "paper_id", "id").select("paper_id", "id", "score", "section")


@query(oracle("""SELECT paper_id, id, format('CANON-{:03d}', row_number() OVER (PARTITION BY paper_id ORDER BY CASE issue_type WHEN 'manuscript_issue' THEN 0 WHEN 'reference_integrity' THEN 1
WHEN 'cannot_verify' THEN 2 WHEN 'bibliography_maintenance' THEN 3 WHEN 'parser_artifact' THEN 4 ELSE 5 END, CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, id)) AS canonical_id FROM findings""", "findings"))
def canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Relations(spark, sf_dir).view("findings").withColumnRenamed("issue_type", "issue_class")
    return R.number(found, "paper_id", "id").select("paper_id", "id", "canonical_id")


@query(oracle("SELECT paper_id, issue_type, severity, count(*) AS n, count(*) FILTER (assessment = 'no') AS n_no FROM findings GROUP BY 1, 2, 3", "findings"))
def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Relations(spark, sf_dir).view("findings")
    return found.groupBy("paper_id", "issue_type", "severity").agg(F.count("*").alias("n"), F.count_if(F.col("assessment") == "no").alias("n_no"))


@query(oracle("""SELECT paper_id, issue_type, page, arg_max(severity, CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS severity,
arg_max(assessment, CASE assessment WHEN 'yes' THEN 1 WHEN 'cannot_verify' THEN 2 WHEN 'partially' THEN 3 ELSE 4 END) AS assessment,
arg_min(confidence, CASE confidence WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS confidence,
string_agg(DISTINCT rater, ',' ORDER BY rater) AS raters, count(*) AS n_findings FROM findings GROUP BY 1, 2, 3""", "findings"))
def merged_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge_group(Relations(spark, sf_dir).view("findings"), ["paper_id", "issue_type", "page"])


@query(oracle(rf"""WITH {SCORED} SELECT paper_id, id, '| ' || id || ' | ' || severity || ' | ' || section || ' | ' ||
 trim(regexp_replace(replace(coalesce(summary, ''), '|', '\|'), '\s+', ' ', 'g')) || ' |' AS line FROM routed""", "findings"))
def brief_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.markdown_rows(_routed(spark, sf_dir), ["id", "severity", "section", "summary"]).select("paper_id", "id", "line")


SAMPLES = """SELECT doc_id AS sample_id, lang AS "case", CASE doc_id % 2 WHEN 0 THEN 'claims' ELSE 'numbers' END AS role, CONCAT('p', CAST(doc_id % 3 AS VARCHAR(9))) AS profile,
CAST(doc_id % 4 AS INT) AS repeat, CASE WHEN doc_id % 10 = 9 THEN 'not-run' WHEN doc_id % 17 = 3 THEN 'failed' ELSE 'complete' END AS status FROM documents"""
RATINGS = """SELECT l.doc_id AS sample_id, l.doc_id * 10 + r.k AS finding_id, CONCAT('issue-', CAST((l.doc_id + r.k * r.k) % 6 AS VARCHAR(9))) AS issue_key,
CASE WHEN l.quality = 1 AND (l.doc_id + r.k * r.k) % 6 < 3 THEN 'confirmed' WHEN l.toxic = 1 THEN 'unresolved' WHEN (l.doc_id + r.k * r.k) % 6 = 5 THEN 'suggestion' ELSE 'false_positive' END AS verdict,
CASE (l.doc_id + r.k) % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'unknown' END AS evidence_correct, CAST((l.doc_id + r.k) % 3 AS INT) AS actionability, r.k AS row
FROM labels l JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 5) r ON l.doc_id % 5 >= r.k"""
TRUTH = """SELECT c.lang AS "case", CONCAT('issue-', CAST(n.n_nationkey AS VARCHAR(9))) AS issue_key, CAST(n.n_nationkey % 3 + 1 AS DOUBLE) AS weight,
CASE WHEN n.n_nationkey % 4 = 3 THEN 'open' ELSE 'confirmed' END AS status, n.n_nationkey % 2 = 0 AS claims_only
FROM (SELECT DISTINCT lang FROM documents) c JOIN (SELECT n_nationkey FROM nation WHERE n_nationkey < 8) n ON TRUE"""
BENCH = f"samples AS ({SAMPLES}), ratings AS ({RATINGS}), truth AS ({TRUTH})"
CELLS = f"""{BENCH}, done AS (SELECT * FROM samples WHERE status = 'complete'),
u AS (SELECT sample_id, issue_key, arg_min(verdict, row) AS verdict FROM ratings GROUP BY 1, 2),
i AS (SELECT sample_id, count(*) FILTER (verdict = 'confirmed') AS c, count(*) FILTER (verdict = 'false_positive') AS f, count(*) FILTER (verdict = 'unresolved') AS u, count(*) AS n FROM u GROUP BY 1),
r AS (SELECT sample_id, count(*) AS n, count(*) FILTER (evidence_correct = 'true') AS t, count(*) FILTER (evidence_correct <> 'unknown') AS k, avg(actionability) AS a FROM ratings GROUP BY 1),
t AS (SELECT d.sample_id, count(*) AS n, count(u.issue_key) AS h, sum(weight) AS w, sum(CASE WHEN u.issue_key IS NOT NULL THEN weight ELSE 0 END) AS hw
 FROM done d JOIN truth t ON t."case" = d."case" AND t.status = 'confirmed' AND (d.role = 'claims' OR NOT t.claims_only) LEFT JOIN u ON u.sample_id = d.sample_id AND u.issue_key = t.issue_key AND u.verdict = 'confirmed' GROUP BY 1),
cells AS (SELECT d.sample_id, d."case", d.role, d.profile, d.repeat, coalesce(i.c, 0) AS confirmed_unique, coalesce(i.f, 0) AS false_positive_unique, coalesce(i.u, 0) AS unresolved_unique,
 coalesce(r.n, 0) - coalesce(i.n, 0) AS duplicate_rows, i.c / nullif(i.c + i.f, 0) AS precision_resolved, i.c / nullif(i.c + i.f + i.u, 0) AS precision_lower,
 (i.c + i.u) / nullif(i.c + i.f + i.u, 0) AS precision_upper, coalesce(t.n, 0) AS reference_issue_count, coalesce(t.h, 0) AS reference_hits, t.h / nullif(t.n, 0) AS recall,
 t.hw / nullif(t.w, 0) AS weighted_recall, r.t / nullif(r.k, 0) AS evidence_accuracy, r.a AS mean_actionability
 FROM done d LEFT JOIN i USING (sample_id) LEFT JOIN r USING (sample_id) LEFT JOIN t USING (sample_id))"""


def _sql(text: str) -> str:
    return text.replace('"case"', "`case`")


def _bench(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    data = Relations(spark, sf_dir)
    truth = data.sql(_sql(TRUTH))
    roles = F.when(F.col("claims_only"), F.array(F.lit("claims"))).otherwise(F.array(F.lit("claims"), F.lit("numbers")))
    return data.sql(_sql(SAMPLES)), data.sql(RATINGS), truth.withColumn("roles", roles)


@query(f"WITH {CELLS} SELECT * FROM cells")
def cell_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.cell_metrics(*_bench(spark, sf_dir))


@query(f"""WITH {CELLS}, paired AS (SELECT "case", role, repeat FROM done GROUP BY 1, 2, 3 HAVING count(DISTINCT profile) = (SELECT count(DISTINCT profile) FROM samples)),
m AS (SELECT profile, count(*) AS matched_cells, avg(precision_resolved) AS precision_macro, count(precision_resolved) AS precision_cells, avg(recall) AS recall_macro, count(recall) AS recall_cells
 FROM cells JOIN paired USING ("case", role, repeat) GROUP BY 1),
p AS (SELECT profile, count(*) AS planned, count(*) FILTER (status <> 'not-run') AS attempted, count(*) FILTER (status = 'complete') AS complete FROM samples GROUP BY 1)
SELECT profile, planned, attempted, complete, coalesce(matched_cells, 0) AS matched_cells, precision_macro, coalesce(precision_cells, 0) AS precision_cells, recall_macro,
 coalesce(recall_cells, 0) AS recall_cells, complete / nullif(attempted, 0) AS completion_rate FROM p LEFT JOIN m USING (profile)""")
def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, ratings, truth = _bench(spark, sf_dir)
    return B.macro_metrics(samples, B.cell_metrics(samples, ratings, truth))


@query(f"""WITH {BENCH}, expected AS (SELECT DISTINCT sample_id, finding_id FROM ratings WHERE finding_id % 7 <> 0 UNION SELECT DISTINCT doc_id, doc_id * 10 + 9 FROM labels WHERE doc_id % 50 = 0),
n AS (SELECT sample_id, finding_id, count(*) AS n FROM ratings GROUP BY 1, 2)
SELECT coalesce(n.sample_id, e.sample_id) AS sample_id, CAST(coalesce(n.finding_id, e.finding_id) AS VARCHAR) AS key, CASE WHEN n IS NULL THEN 'missing' WHEN e.finding_id IS NULL THEN 'extra' ELSE 'duplicate' END AS error
FROM n FULL JOIN expected e ON n.sample_id = e.sample_id AND n.finding_id = e.finding_id WHERE n.n IS NULL OR e.finding_id IS NULL OR n.n > 1
UNION ALL SELECT sample_id, CAST(finding_id AS VARCHAR), 'verdict' FROM ratings WHERE verdict IS NULL OR verdict NOT IN ('confirmed', 'false_positive', 'unresolved', 'suggestion')
UNION ALL SELECT sample_id, issue_key, 'conflict' FROM ratings GROUP BY 1, 2 HAVING count(DISTINCT verdict) > 1""")
def rating_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ratings, _ = _bench(spark, sf_dir)
    late = Relations(spark, sf_dir).table("labels").where("doc_id % 50 = 0").select(F.col("doc_id").alias("sample_id"), (F.col("doc_id") * 10 + 9).alias("finding_id"))
    return B.rating_errors(ratings, ratings.where("finding_id % 7 <> 0").select("sample_id", "finding_id").union(late))


@query("""SELECT d.lang AS "case", r.role, 'p' || p.k AS profile, t.k AS repeat FROM (SELECT DISTINCT lang FROM documents) d,
(VALUES ('claims'), ('numbers')) r(role), range(3) p(k), range(1, 3) t(k)""")
def schedule_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = Relations(spark, sf_dir).table("documents").select(F.col("lang").alias("case")).distinct()
    cases = cases.withColumn("roles", F.array(F.lit("claims"), F.lit("numbers")))
    profiles = spark.createDataFrame([("p0",), ("p1",), ("p2",)], "profile string")
    return B.schedule(cases, profiles, 2, 20260924).drop("job")


LOG = """SELECT user_id AS job, event_id, CASE WHEN event_id % 97 = 0 THEN '{"type": "turn.completed", "usage": {"input_tokens": ' || event_id || ', "cached_input_tokens": ' || CAST(event_id % 120 AS VARCHAR(9))
|| ', "output_tokens": ' || CAST(event_id % 31 AS VARCHAR(9)) || '}}' WHEN event_id % 501 = 0 THEN 'truncated {' ELSE props END AS line FROM events"""


@query(f"""WITH l AS ({LOG}), e AS (SELECT job, try_cast(line AS JSON) AS j, line FROM l),
g AS (SELECT job, count(*) FILTER (j->>'type' = 'turn.completed') AS turns, bool_or(j IS NULL) AS bad, max((j->'usage'->>'input_tokens')::BIGINT) AS total,
 max((j->'usage'->>'cached_input_tokens')::BIGINT) AS cached, max((j->'usage'->>'output_tokens')::BIGINT) AS out FROM e GROUP BY job),
s AS (SELECT *, CASE WHEN bad THEN 'unavailable' WHEN turns <> 1 THEN 'ambiguous-or-incomplete' WHEN cached <= total THEN 'reported' ELSE 'unavailable' END AS status FROM g)
SELECT job, status, CASE WHEN status = 'reported' THEN total END AS input_total, CASE WHEN status = 'reported' THEN cached END AS input_cached,
 CASE WHEN status = 'reported' THEN total - cached END AS input_uncached, CASE WHEN status = 'reported' THEN out END AS output FROM s""")
def usage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.usage(Relations(spark, sf_dir).sql(LOG))


@query(f"""SELECT sample_id AS job, 's' || lpad(CAST(row_number() OVER (ORDER BY sha256('20260924:' || sample_id)) AS VARCHAR), 6, '0') AS sample_id FROM ({SAMPLES})""")
def blind_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in a hidden order, numbered."""
    samples = Relations(spark, sf_dir).sql(_sql(SAMPLES))
    return B.blind_packet(samples.withColumnRenamed("sample_id", "job").select("job"), 20260924, 1)
