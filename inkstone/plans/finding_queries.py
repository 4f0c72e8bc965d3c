"""Queries on findings: accessors, merged groups, areas, briefs, contracts, second looks, selections, clusters, arithmetic."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import findings as N
from ..functions import predicates as P
from ..functions import text as T
from ..operators import benchmark as B
from ..operators import checks as C
from ..operators import editorial as E
from ..operators import numeric as A
from ..operators import pairs as W
from ..operators import ranking as R
from ..operators import resolve as S
from ..operators import schema as J
from ..session import spread
from ..sources.views import Relations, oracle
from .ranking_queries import SCORED, _routed
from .registry import query

_ID = "concat('F-', lpad(CAST({k} AS VARCHAR(9)), 3, '0'))"
#: Findings of orders, told and not told in turns.
TOLD = f"""SELECT o_orderkey AS k, concat('paper-', CAST(o_custkey % 50 AS VARCHAR(9))) AS paper_id, CASE o_custkey % 3 WHEN 0 THEN 'numerical_auditor' WHEN 1 THEN 'claim_evidence_auditor' ELSE 'unknown_auditor' END AS rater,
 CASE WHEN o_orderkey % 41 = 0 THEN 'bad' WHEN o_orderkey % 43 = 0 THEN 'F-001' ELSE {_ID.format(k="o_orderkey % 900")} END AS id, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN NULL ELSE concat(' Sum ', chr(10), o_orderstatus) END AS finding_summary,
 CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '' END AS evidence_summary, o_orderpriority AS claim_text, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'parser_artifact' WHEN 2 THEN 'cannot_verify' ELSE 'other' END AS issue_type,
 CASE o_orderkey % 6 WHEN 0 THEN 'Cannot_Verify: data' ELSE 'numbers' END AS category, CASE o_custkey % 5 WHEN 0 THEN 'dire' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, CASE o_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'high' ELSE 'low' END AS confidence,
 CASE o_orderkey % 9 WHEN 0 THEN 'cannot_verify' WHEN 1 THEN 'maybe' ELSE 'no' END AS assessment, CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '12a' ELSE CAST(o_orderkey % 30 AS VARCHAR(9)) END AS page_text,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN '' ELSE 'iv' END AS page_label, CASE WHEN o_custkey % 6 = 0 THEN 'Data' END AS section, CASE WHEN o_custkey % 7 = 0 THEN concat('quote ', o_orderstatus) END AS text_quote,
 CASE o_orderkey % 10 WHEN 0 THEN 'missing' WHEN 1 THEN '' ELSE 'exact' END AS precision, CASE WHEN o_custkey % 8 = 0 THEN 'no data' ELSE '' END AS cannot_verify_reason,
 CASE o_orderkey % 11 WHEN 0 THEN '{{"kind": null, "inputs": []}}' WHEN 1 THEN NULL ELSE '{{"kind": "arithmetic"}}' END AS numeric_check, CASE WHEN o_custkey % 9 = 0 THEN 'fix it' END AS suggested_fix FROM orders"""
_SQUASHED = "trim(regexp_replace(%s, '\\s+', ' ', 'g'))"


@query(f"""WITH t AS ({TOLD}) SELECT k, coalesce({_SQUASHED % "CASE WHEN finding_summary <> '' THEN finding_summary WHEN evidence_summary <> '' THEN evidence_summary ELSE claim_text END"}, '') AS problem,
CASE WHEN confidence = '' THEN 'medium' ELSE confidence END AS confidence, CASE WHEN regexp_matches(page_text, '^-?[0-9]+$') THEN TRY_CAST(page_text AS INT) END AS page,
CASE WHEN len(p) > 0 THEN array_to_string(p, ', ') ELSE 'location not specified' END AS location, id || CASE WHEN {_SQUASHED % "coalesce(finding_summary, '')"} <> '' THEN ': ' || {_SQUASHED % "finding_summary"} WHEN claim_text <> '' THEN ': ' || claim_text ELSE '' END AS label,
CASE WHEN rater <> 'unknown_auditor' THEN rater || ':' || id ELSE '' END || CASE WHEN rater <> 'unknown_auditor' AND evidence_summary <> '' THEN '; ' ELSE '' END || CASE WHEN evidence_summary <> '' THEN 'numerical_auditor:' || evidence_summary ELSE '' END AS sources,
array_to_string(list_sort(list_distinct(list_concat(CASE WHEN rater <> 'unknown_auditor' THEN [rater] ELSE [] END, ['numerical_auditor', 'z']))), ',') AS raters
FROM (SELECT *, list_filter([CASE WHEN TRY_CAST(page_text AS INT) IS NOT NULL THEN 'page ' || CAST(TRY_CAST(page_text AS INT) AS VARCHAR) END, CASE WHEN page_label <> '' THEN 'label ' || page_label END, section], lambda x: x IS NOT NULL) AS p FROM t)""")
def finding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, places, labels and sources of findings as far as they are told."""
    c = F.col
    rows = Relations(spark, sf_dir).sql(TOLD)
    none = F.when(c("rater") == "unknown_auditor", "").otherwise(c("rater"))
    sources = F.array(F.struct(none.alias("rater"), c("id").alias("id")), F.struct(F.lit("numerical_auditor").alias("rater"), c("evidence_summary").alias("id")))
    page = N.page_of(c("page_text"))
    return rows.select(
        "k", N.problem_text(c("finding_summary"), c("evidence_summary"), c("claim_text")).alias("problem"), N.confidence(c("confidence")).alias("confidence"), page.alias("page"),
        N.location_text(page, c("page_label"), c("section")).alias("location"), N.label(c("id"), c("finding_summary"), c("claim_text")).alias("label"), N.source_ids(sources).alias("sources"),
        F.array_join(N.rater_names(F.array(F.lit("z")), sources), ",").alias("raters"),
    )


@query(f"""WITH t AS ({TOLD}) SELECT k, assessment = 'cannot_verify' OR coalesce(issue_type = 'cannot_verify', FALSE) OR lower(category) LIKE '%cannot_verify%' AS in_contract, coalesce(issue_type = 'cannot_verify', FALSE) OR assessment = 'cannot_verify' OR cannot_verify_reason <> '' AS in_brief,
severity IN ('high', 'medium') AND coalesce(issue_type IN ('cannot_verify'), FALSE) AS material, CASE WHEN issue_type = 'parser_artifact' AND severity = 'high' AND confidence = 'high' THEN 'blocker' WHEN issue_type = 'parser_artifact' AND severity IN ('high', 'medium') THEN 'warning' END AS gate,
severity IN ('high', 'medium') AND coalesce(issue_type = 'cannot_verify', FALSE) AS in_body FROM t""")
def finding_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What counts as unverifiable, as material, as a gate and for a report's body."""
    c = F.col
    reasons = F.filter(F.array("cannot_verify_reason"), lambda x: x != "")
    return Relations(spark, sf_dir).sql(TOLD).select(
        "k", N.unverifiable_in_contract(c("assessment"), c("issue_type"), c("category")).alias("in_contract"), N.unverifiable_in_brief(c("issue_type"), c("assessment"), reasons).alias("in_brief"),
        E.material(c("severity"), c("issue_type")).alias("material"), P.parser_gate(c("issue_type"), c("severity"), c("confidence")).alias("gate"), P.body_coverage(c("severity"), c("issue_type")).alias("in_body"),
    )


@query("""SELECT conv_id, string_agg(name || '=' || reason, ';' ORDER BY name) AS reasons FROM (SELECT conv_id, 'r' || turn AS name, CASE WHEN turn % 3 = 0 THEN 'selected by rater applicability routing' ELSE role END AS reason FROM conversations WHERE turn % 4 <> 3) GROUP BY 1""")
def selection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why raters were selected, with the stated default."""
    c = F.col
    name, reason = F.when(c("turn") % 4 == 3, "").otherwise(F.concat(F.lit("r"), "turn")), F.when(c("turn") % 3 == 0, "").otherwise(c("role"))
    rows = Relations(spark, sf_dir).table("conversations").groupBy("conv_id").agg(F.collect_list(F.struct(name.alias("name"), reason.alias("reason"))).alias("s"))
    pairs = F.array_sort(F.transform(F.map_entries(N.selection_reasons(c("s"))), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return rows.select("conv_id", F.array_join(pairs, ";").alias("reasons")).where("reasons <> ''")


@query(f"""WITH t AS ({TOLD}), s AS (SELECT paper_id, list({{'p': page_text, 'r': rater, 'i': id, 'k': k, 'c': category, 's': finding_summary, 'q': text_quote, 'e': evidence_summary, 'v': cannot_verify_reason, 'f': suggested_fix}} ORDER BY k) AS l FROM t GROUP BY 1)
SELECT paper_id, l[1].s AS finding_summary, l[1].p AS page, len(l) AS n, array_to_string(list_transform(l, lambda x: x.r || ':' || x.i), ';') AS sources,
 array_to_string(list_distinct_in_order, ',') AS raters, len(list_filter(l, lambda x: x.e <> '')) AS n_evidence, array_to_string(list_transform(list_filter(l, lambda x: x.v <> ''), lambda x: x.i), ',') AS reasons, len(list_filter(l, lambda x: x.f <> '')) AS n_fixes,
 len(list_distinct(list_filter(list_transform(l, lambda x: x.q), lambda x: x IS NOT NULL))) AS n_quotes, len(list_distinct(list_filter(list_transform(l, lambda x: x.p), lambda x: x IS NOT NULL))) AS n_pages
FROM (SELECT *, list_transform(list_sort(list_transform(list_distinct(list_transform(l, lambda x: x.r)), lambda r: {{'at': list_position(list_transform(l, lambda x: x.r), r), 'r': r}})), lambda x: x.r) AS list_distinct_in_order FROM s)""")
def merged_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of what raters say of one matter: here of each paper."""
    c = F.col
    rows = Relations(spark, sf_dir).sql(TOLD).withColumn("page", c("page_text")).withColumn("quote", c("text_quote"))
    out = R.merged_findings(rows, ["paper_id"], ["k"])
    pair = F.transform("sources", lambda s: F.concat_ws(":", s["rater"], s["id"]))
    return out.select(
        "paper_id", "finding_summary", "page", F.size("sources").alias("n"), F.array_join(pair, ";").alias("sources"), F.array_join("raters", ",").alias("raters"), F.size("evidence").alias("n_evidence"),
        F.array_join(F.transform("reasons", lambda r: r["id"]), ",").alias("reasons"), F.size("fixes").alias("n_fixes"), F.size("quotes").alias("n_quotes"), F.size("pages").alias("n_pages"),
    )


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN CASE WHEN user_id % 2 = 0 THEN 'Source consistency' WHEN user_id % 3 = 0 THEN 'Literature' WHEN user_id % 5 = 0 THEN 'Economic magnitude' ELSE 'Manuscript' END
 WHEN event_id % 7 = 1 THEN 'Reference integrity' WHEN event_id % 7 = 2 THEN 'Bibliography maintenance' WHEN event_id % 7 = 3 THEN 'Parser/preprocessing' WHEN event_id % 7 = 4 THEN 'Cannot verify' WHEN event_id % 7 = 5 THEN 'Grammar/copyediting' ELSE 'Other' END AS area FROM events""")
def finding_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of findings by class, and of issues of the paper by the first of their raters that has one."""
    c = F.col
    kinds = F.array(*map(F.lit, ("manuscript_issue", "reference_integrity", "bibliography_maintenance", "parser_artifact", "cannot_verify", "copyedit_issue", "no_class")))
    names = [F.when(c("user_id") % n == 0, name) for n, name in ((5, "economic_magnitude_auditor"), (3, "literature_auditor"), (2, "source_consistency_auditor"))]
    kind = F.element_at(kinds, (c("event_id") % 7 + 1).cast("int"))
    return Relations(spark, sf_dir).table("events").select("event_id", R.area(kind, F.array_compact(F.array(*names))).alias("area"))


_TO = "CASE section WHEN 'highest_priority' THEN 'Priorities' WHEN 'cannot_verify' THEN 'Cannot verify' WHEN 'literature' THEN 'Literature' WHEN 'grammar_appendix' THEN 'Grammar' WHEN 'parser_appendix' THEN 'Parser' WHEN 'reference_integrity' THEN 'References' WHEN 'bibliography_appendix' THEN 'Bibliography' ELSE 'Additional Findings' END"
_SECTIONS = {"highest_priority": "Priorities", "cannot_verify": "Cannot verify", "literature": "Literature", "grammar_appendix": "Grammar", "parser_appendix": "Parser", "reference_integrity": "References", "bibliography_appendix": "Bibliography"}


def _table(heads: str, line: str, where: str, first: str = "0") -> str:
    rows = f"string_agg({line}, chr(10) ORDER BY {first}, cid) FILTER ({where})"
    rule = " | ".join("---" for _ in heads.split(" | "))
    return f"coalesce('| {heads} |' || chr(10) || '| {rule} |' || chr(10) || {rows}, '_None._')"


@query(oracle(rf"""WITH {SCORED}, r AS (SELECT *, lpad(id::VARCHAR, 9, '0') AS cid, CASE WHEN length(p) > 120 THEN rtrim(left(p, 117)) || '...' ELSE p END AS issue, {_TO} AS dest, coalesce('page ' || page, 'location not specified') AS loc
 FROM (SELECT *, trim(regexp_replace(replace(summary, '|', '\|'), '\s+', ' ', 'g')) AS p FROM routed))
SELECT paper_id, '# Editor Brief' || chr(10) || chr(10) || '## Run Summary' || chr(10) || chr(10) || '- findings: ' || count(*) || chr(10) || '- classes: ' || concat_ws(', ', {", ".join(f"'{k} ' || count(*) FILTER (issue_type = '{k}')" for k in R.CLASS_ORDER)})
 || chr(10) || '- severities: ' || concat_ws(', ', {", ".join(f"'{k} ' || count(*) FILTER (severity = '{k}')" for k in ("high", "medium", "low"))}) || chr(10) || '- confidences: ' || concat_ws(', ', {", ".join(f"'{k} ' || count(*) FILTER (confidence = '{k}')" for k in ("high", "medium", "low"))})
 || chr(10) || chr(10) || '## Machine-Ranked Candidate Findings' || chr(10) || chr(10) || {_table("Canonical ID | Severity | Confidence | Issue", "'| ' || concat_ws(' | ', cid, severity, confidence, issue) || ' |'", "section = 'highest_priority'", "-score")}
 || chr(10) || chr(10) || '## Additional Findings Candidates' || chr(10) || chr(10) || {_table("Area | Canonical ID | Location | Issue", "'| ' || concat_ws(' | ', 'Manuscript', cid, loc, issue) || ' |'", "section = 'additional'")}
 || chr(10) || chr(10) || '## Required Body Coverage Audit' || chr(10) || chr(10) || {_table("Canonical ID | Class | Severity | Location | Issue", "'| ' || concat_ws(' | ', cid, issue_type, severity, loc, issue) || ' |'", "severity <> 'low' AND issue_type IN ('manuscript_issue', 'cannot_verify', 'reference_integrity')")}
 || chr(10) || chr(10) || '## Section Routing Guidance' || chr(10) || chr(10) || {_table("Canonical ID | Recommended section | Location", "'| ' || concat_ws(' | ', cid, dest, loc) || ' |'", "TRUE")}
 || chr(10) || chr(10) || '## Traceability Map Rows' || chr(10) || chr(10) || {_table("Report section | Finding | Canonical ID | Source finding IDs", "'| ' || concat_ws(' | ', dest, issue, cid, rater || ':' || id) || ' |'", "TRUE")} || chr(10) AS brief FROM r GROUP BY 1""", "findings"))
def editor_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole briefs: counts, ranked and additional candidates, required coverage, routes and map rows of each paper."""
    c = F.col
    rows = _routed(spark, sf_dir).withColumnRenamed("issue_type", "issue_class")
    empty = F.array().cast("array<string>")
    rows = rows.select(
        "paper_id", F.lpad(c("id").cast("string"), 9, "0").alias("canonical_id"), "severity", "confidence", "issue_class", "score", "section", R.area(c("issue_class"), empty).alias("area"),
        N.location_text(c("page"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("location"), R.markdown_cell(c("summary")).alias("problem"), F.concat_ws(":", "rater", "id").alias("source_ids"),
    )
    rows = rows.withColumn("problem", F.replace("problem", F.lit("\\|"), F.lit("|")))
    return R.brief(rows, _SECTIONS)


@query("""SELECT conv_id::VARCHAR AS paper_id, CASE WHEN p <= 3000 THEN 'pretty' WHEN m <= 3000 THEN 'minified' WHEN f <= 3000 THEN 'file-backed' ELSE 'too large' END AS serialization, CASE WHEN p <= 3000 THEN p WHEN m <= 3000 THEN m WHEN f <= 3000 THEN f END AS bytes
FROM (SELECT conv_id, strlen(string_agg(text, chr(10) || '  ' ORDER BY turn)) AS p, strlen(string_agg(text, '' ORDER BY turn)) AS m, count(*) * 400 AS f FROM conversations WHERE text IS NOT NULL GROUP BY 1)""")
def bounded_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first form of a conversation that is within three thousand bytes; nothing is cut."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    rows = Relations(spark, sf_dir).table("conversations").where("text is not null").groupBy(F.col("conv_id").cast("string").alias("paper_id")).agg(texts.alias("t"))
    forms = rows.select("paper_id", F.array_join("t", "\n  ").alias("pretty"), F.array_join("t", "").alias("minified"), F.repeat(F.lit("x"), F.size("t") * 400).alias("file_backed"))
    return R.bounded_input(forms, 3000).select("paper_id", "serialization", F.octet_length("document").alias("bytes"))


ROSTER = [("numerical_auditor", "F"), ("claim_evidence_auditor", "F")]
SOURCES = """SELECT k, paper_id, rater, id, concat('s', CAST(n_nationkey AS VARCHAR(9))) AS source_id, CASE WHEN n_nationkey = 0 AND k % 5 = 0 THEN 'http://plain.org' WHEN n_nationkey = 0 AND k % 5 = 1 THEN 'https://a.org/x' END AS url,
 CASE WHEN n_nationkey = 1 AND k % 7 = 0 THEN '../up.txt' WHEN n_nationkey = 1 THEN 'pages/page_1.txt' END AS path, CASE WHEN k % 13 = 0 THEN 99 ELSE 3 END AS page FROM ({told}) t JOIN nation ON n_nationkey < k % 3""".format(told=TOLD)
LINKS = "SELECT paper_id, rater, id, 0 AS link, CASE WHEN k % 17 = 0 THEN NULL WHEN k % 19 = 0 THEN 's9' ELSE 's0' END AS source_id FROM ({told}) t WHERE k % 3 > 0".format(told=TOLD)
_CONTRACT = {
    "rater": "rater = 'unknown_auditor'", "duplicate id": "times > 1", "id": "rater <> 'unknown_auditor' AND id = 'bad'", "issue type": "issue_type IS NULL", "severity": "severity = 'dire'", "confidence": "confidence = ''", "assessment": "assessment = 'maybe'",
    "summary": "trim(coalesce(finding_summary, '')) = ''", "precision": "precision = ''", "placed but missing": "precision = 'missing' AND placed", "exact but nowhere": "precision = 'exact' AND NOT placed", "page": "page < 1 OR page > 25",
    "no reason": "open AND cannot_verify_reason = ''", "no sources": "NOT open AND n = 0", "no numeric check": "rater = 'numerical_auditor' AND coalesce(issue_type, '') <> 'parser_artifact' AND NOT open AND numeric_check IS NULL",
    "empty numeric check": "contains(numeric_check, 'null')",
}


@query(f"""WITH t AS ({TOLD}), src AS ({SOURCES}), lnk AS ({LINKS}), x AS (SELECT t.*, count(*) OVER (PARTITION BY paper_id, rater, id) AS times, TRY_CAST(page_text AS INT) AS page,
 coalesce(CAST(TRY_CAST(page_text AS INT) AS VARCHAR), page_label, section, text_quote) IS NOT NULL AS placed, assessment = 'cannot_verify' OR coalesce(issue_type = 'cannot_verify', FALSE) OR category LIKE 'Cannot%' AS open,
 (SELECT count(*) FROM src s WHERE s.paper_id = t.paper_id AND s.rater = t.rater AND s.id = t.id) AS n FROM t),
e AS ({" UNION ALL ".join(f"SELECT paper_id, rater, id, '{n}' AS error FROM x WHERE {r}" for n, r in _CONTRACT.items())}
 UNION ALL SELECT paper_id, rater, id, 'source url' FROM src WHERE url = 'http://plain.org' UNION ALL SELECT paper_id, rater, id, 'source path' FROM src WHERE path = '../up.txt' UNION ALL SELECT paper_id, rater, id, 'source place' FROM src WHERE url IS NULL AND path IS NULL
 UNION ALL SELECT paper_id, rater, id, 'source page' FROM src WHERE page > 25 UNION ALL SELECT paper_id, rater, id, 'empty link' FROM lnk WHERE source_id IS NULL
 UNION ALL SELECT paper_id, rater, id, 'link to unknown source' FROM lnk l WHERE source_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM src s WHERE s.paper_id = l.paper_id AND s.rater = l.rater AND s.id = l.id AND s.source_id = l.source_id))
SELECT DISTINCT * FROM e""")
def finding_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings held against the contract."""
    data = Relations(spark, sf_dir)
    rows = data.sql(TOLD).withColumn("page", N.page_of(F.col("page_text"))).withColumn("page_count", F.lit(25))
    return C.finding_errors(rows, spark.createDataFrame(ROSTER, "rater string, id_prefix string"), data.sql(SOURCES), data.sql(LINKS))


_Q = """'{{"value":"', {value}, '","source_id":"', {source}, '","unit":"usd","sample":"all","denominator":"n","context":"c","rounding_half_width":"0","scale":"', {scale}, '"}}'"""
_QUOTE = "CONCAT('we report ', CAST(k % 90 + 2 AS VARCHAR(9)), ' and ', CAST(k % 7 + 3 AS VARCHAR(9)), '%, of ', CAST(k % 50 + 200 AS VARCHAR(9)))"
_CROSS = """'{"kind":"', CASE WHEN k % 41 = 0 THEN 'cross' ELSE 'cross_source' END, '","quantities":[', """ + _Q.format(value="CASE WHEN k % 11 = 0 THEN '7777' ELSE CAST(k % 90 + 2 AS VARCHAR(9)) END", source="CASE WHEN k % 23 = 5 THEN 's2' ELSE 's1' END", scale="'number'") + ", CASE WHEN k % 43 = 1 THEN '' ELSE CONCAT(',', " + _Q.format(value="CAST(k % 7 + 3 AS VARCHAR(9))", source="'s1'", scale="CASE WHEN k % 9 = 0 THEN 'number' ELSE 'percent' END") + ") END, " + """'],"comparability":"', CASE WHEN k % 17 = 3 THEN ' ' ELSE 'same' END, '","observed_discrepancy":"o","possible_explanation":"p","suggested_correction":"s"}'"""
#: Reviews as JSON texts, one a customer: members missing, unknown or of another kind, contracts and numbers broken.
REVIEWS = f"""SELECT CONCAT('paper-', CAST(k AS VARCHAR(9))) AS paper_id, 'numerical_auditor' AS rater, CONCAT('{{"reviewer":"', CASE WHEN k % 37 = 4 THEN 'another' ELSE 'numerical_auditor' END, '","paper_id":"paper-', CAST(k AS VARCHAR(9)), '","run_status":"', CASE WHEN k % 31 = 0 THEN 'done' ELSE 'ok' END,
 '","summary":', CASE WHEN k % 29 = 1 THEN '7' ELSE '"s"' END, ',"findings":[{{"id":"', CASE WHEN k % 19 = 2 THEN 'bad' ELSE 'N-001' END, '","category":"c","finding_summary":"', CASE WHEN k % 47 = 3 THEN '' ELSE 'off' END, '","issue_type":"manuscript_issue","severity":"', CASE WHEN k % 53 = 1 THEN 'dire' ELSE 'high' END,
 '","confidence":"low","location":{{"page":', CASE WHEN k % 59 = 2 THEN '"two"' ELSE CAST(k % 12 AS VARCHAR(9)) END, CASE WHEN k % 61 = 3 THEN '' ELSE ',"page_label":null' END, ',"section":null,"text_quote":null,"precision":"exact"', CASE WHEN k % 67 = 4 THEN ',"line":3' ELSE '' END,
 '}},"claim_text":"c","assessment":"no","cannot_verify_reason":null,"evidence_summary":"e","source_objects":[{{"id":"s1","type":"text","label":null,"path":"pages/p.txt","page":2,"page_label":null,"section":null,"text_quote":"', {_QUOTE}, '","url":null,"object_id":"O","correspondence":"', CASE WHEN k % 13 = 6 THEN 'unresolved' ELSE 'text' END,
 '","verification_note":null}}],"claim_evidence_links":[{{"claim_text":"c","source_object_ids":[', CASE WHEN k % 71 = 5 THEN '"s9"' ELSE '"s1"' END, '],"relation":"supports","note":null}}],"numeric_check":', {_CROSS}, ',"suggested_fix":"f"}}],"notes":["n"', CASE WHEN k % 73 = 6 THEN ',3' ELSE '' END, '],"completion":null', CASE WHEN k % 79 = 7 THEN '' ELSE ',"coverage":[]' END, CASE WHEN k % 83 = 8 THEN '}}}}' ELSE '}}' END) AS document
FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey IS NOT NULL) c"""
_AT = "json_extract_string(document, '$.{}')"
_TYPE = "json_type(document, '$.{}')"
_BROKEN = {
    ("run_status", "enum"): f"{_AT.format('run_status')} NOT IN ('ok', 'partial', 'cannot_verify', 'failed')", ("summary", "type"): f"{_TYPE.format('summary')} <> 'VARCHAR'",
    ("findings.0.finding_summary", "minLength"): f"length({_AT.format('findings[0].finding_summary')}) < 1", ("findings.0.severity", "enum"): f"{_AT.format('findings[0].severity')} NOT IN ('high', 'medium', 'low')",
    ("findings.0.location.page", "type"): f"{_TYPE.format('findings[0].location.page')} NOT IN ('UBIGINT', 'BIGINT', 'NULL')", ("findings.0.location", "required page_label"): "NOT list_contains(json_keys(document, '$.findings[0].location'), 'page_label')",
    ("findings.0.location", "additionalProperties line"): "list_contains(json_keys(document, '$.findings[0].location'), 'line')", ("notes.1", "type"): f"coalesce({_TYPE.format('notes[1]')}, 'VARCHAR') <> 'VARCHAR'",
    ("", "required coverage"): "NOT list_contains(json_keys(document), 'coverage')",
    ("findings.0.numeric_check", "anyOf"): f"{_AT.format('findings[0].numeric_check.kind')} <> 'cross_source' OR json_array_length(document, '$.findings[0].numeric_check.quantities') < 2",
}


@query(f"""WITH r AS ({REVIEWS}), j AS (SELECT * FROM r WHERE json_valid(document)),
e AS (SELECT paper_id, '' AS place, 'json' AS error FROM r WHERE NOT json_valid(document) UNION ALL {" UNION ALL ".join(f"SELECT paper_id, '{place}', '{error}' FROM j WHERE {rule}" for (place, error), rule in _BROKEN.items())}),
s AS (SELECT * FROM j WHERE paper_id NOT IN (SELECT paper_id FROM e)), f AS (SELECT *, {_AT.format('findings[0].id')} AS id, CAST({_AT.format('findings[0].location.page')} AS INT) AS page FROM s),
c AS (SELECT paper_id, '' AS place, 'reviewer' AS error FROM f WHERE {_AT.format('reviewer')} <> rater UNION ALL SELECT paper_id, id, 'id' FROM f WHERE NOT regexp_matches(id, '^N-[0-9]{{3}}$') UNION ALL SELECT paper_id, id, 'page' FROM f WHERE page NOT BETWEEN 1 AND 10
 UNION ALL SELECT paper_id, id, 'link to unknown source' FROM f WHERE {_AT.format('findings[0].claim_evidence_links[0].source_object_ids[0]')} <> {_AT.format('findings[0].source_objects[0].id')}),
n AS (SELECT paper_id, id, {_AT.format('findings[0].source_objects[0].text_quote')} AS quote, {_AT.format('findings[0].source_objects[0].id')} AS source, {_AT.format('findings[0].source_objects[0].correspondence')} AS how, {_AT.format('findings[0].numeric_check.comparability')} AS same,
 unnest([{{'v': {_AT.format('findings[0].numeric_check.quantities[0].value')}, 's': {_AT.format('findings[0].numeric_check.quantities[0].source_id')}, 'x': {_AT.format('findings[0].numeric_check.quantities[0].scale')}}}, {{'v': {_AT.format('findings[0].numeric_check.quantities[1].value')}, 's': {_AT.format('findings[0].numeric_check.quantities[1].source_id')}, 'x': {_AT.format('findings[0].numeric_check.quantities[1].scale')}}}]) AS q
 FROM f WHERE paper_id NOT IN (SELECT paper_id FROM c)),
m AS (SELECT paper_id, id, 'cross source' AS error FROM n WHERE trim(same) = '' UNION ALL SELECT paper_id, id, 'undeclared source' FROM n WHERE q.s <> source UNION ALL SELECT paper_id, id, 'unresolved source' FROM n WHERE q.s = source AND how = 'unresolved'
 UNION ALL SELECT paper_id, id, 'not in quote' FROM n WHERE q.s = source AND how = 'text' AND NOT regexp_matches(quote, '(^| )' || q.v || '([ %,]|$)')
 UNION ALL SELECT paper_id, id, 'percent scale' FROM n WHERE q.s = source AND how = 'text' AND q.x <> 'percent' AND regexp_matches(quote, '(^| )' || q.v || '%') AND NOT regexp_matches(quote, '(^| )' || q.v || '([ ,]|$)'))
SELECT DISTINCT paper_id, 'numerical_auditor' AS rater, stage, place, error FROM (SELECT paper_id, 'schema' AS stage, place, error FROM e UNION ALL SELECT paper_id, 'contract', place, error FROM c UNION ALL SELECT paper_id, 'numeric', id, error FROM m)""")
def review_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole reviews as JSON texts, held against schema, contract and numbers."""
    data = Relations(spark, sf_dir)
    reviews = data.sql(REVIEWS)
    pages = reviews.select("paper_id", F.lit(10).alias("page_count"))
    return J.review_errors(reviews, spark.createDataFrame([("numerical_auditor", "N")], "rater string, id_prefix string"), pages)


#: Raters of rosters, one roster a customer: blank, missing, unknown and repeated values, flags that are none.
_RATERS = """SELECT o_custkey AS roster, o_orderkey AS k, CONCAT('{"name":"', CASE WHEN o_orderkey % 61 = 0 THEN ' ' WHEN o_orderkey % 37 = 1 THEN 'twice' ELSE CONCAT('r', CAST(o_orderkey AS VARCHAR(20))) END, '","prompt":"p', CAST(o_orderkey AS VARCHAR(20)), '","output":"', CASE WHEN o_orderkey % 41 = 2 THEN 'out ' WHEN o_orderkey % 41 = 3 THEN 'out' ELSE CONCAT('o', CAST(o_orderkey AS VARCHAR(20))) END,
 '"', CASE WHEN o_orderkey % 97 = 4 THEN '' ELSE CONCAT(',"id_prefix":"X', CAST(o_orderkey AS VARCHAR(20)), '"') END, ',"normalization_role":"', CASE WHEN o_orderkey % 89 = 5 THEN 'other' ELSE 'manuscript' END, '"', CASE WHEN o_orderkey % 83 = 6 THEN ',"search":"yes"' ELSE '' END, CASE WHEN o_custkey % 19 = 7 THEN ',"enabled":false' ELSE '' END, CASE WHEN o_orderkey % 79 = 8 THEN ',"stage":"late"' ELSE '' END, ',"note":1}') AS rater FROM orders"""


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY roster ORDER BY k) - 1 AS i FROM ({_RATERS})),
e AS (SELECT roster, 'reviewers.' || i AS place, 'required id_prefix' AS error FROM r WHERE json_extract(rater, '$.id_prefix') IS NULL UNION ALL SELECT roster, 'reviewers.' || i || '.normalization_role', 'enum' FROM r WHERE json_extract_string(rater, '$.normalization_role') NOT IN ('manuscript', 'crossref', 'reference', 'copyedit')
 UNION ALL SELECT roster, 'reviewers.' || i || '.search', 'type' FROM r WHERE coalesce(json_type(rater, '$.search'), 'BOOLEAN') <> 'BOOLEAN' UNION ALL SELECT roster, 'reviewers.' || i || '.stage', 'enum' FROM r WHERE coalesce(json_extract_string(rater, '$.stage'), 'review') NOT IN ('preflight', 'review')),
s AS (SELECT * FROM r WHERE roster NOT IN (SELECT roster FROM e)), v AS (SELECT roster, i, p, trim(json_extract_string(rater, '$.' || p)) AS x FROM s, (VALUES ('name'), ('prompt'), ('output'), ('id_prefix')) t(p)),
d AS (SELECT roster, 'reviewers.' || i || '.' || p AS place, CASE WHEN x = '' THEN 'blank' WHEN i > min(i) OVER (PARTITION BY roster, p, x) THEN 'duplicate' END AS error FROM v)
SELECT * FROM e UNION ALL SELECT * FROM d WHERE error IS NOT NULL UNION ALL SELECT roster, 'reviewers', 'none enabled' FROM s GROUP BY roster HAVING bool_and(coalesce(json_extract_string(rater, '$.enabled'), 'true') = 'false')""")
def roster_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rosters as JSON documents, held against their schema and their rules."""
    rows = Relations(spark, sf_dir).sql(_RATERS)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", "rater"))), lambda x: x["rater"])
    document = F.concat(F.lit('{"reviewers":['), F.array_join(ordered, ","), F.lit("]}"))
    return J.roster_errors(rows.groupBy("roster").agg(document.alias("document")))


@query("""SELECT 'p' || a.p_partkey AS paper_id, CAST(NULL AS VARCHAR) AS subject, 'version or paper' AS error FROM part a WHERE p_size % 5 = 0 OR p_size IS NULL OR p_partkey % 7 = 3 OR p_partkey % 11 = 4""")
def identity_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editorial artifacts of another version, or of another paper than their findings."""
    rows = Relations(spark, sf_dir).table("part").selectExpr("concat('p', p_partkey) AS paper_id", "p_partkey AS k", "CASE WHEN p_size % 5 = 0 THEN 2 WHEN p_size IS NOT NULL THEN 1 END AS version")
    artifacts = rows.selectExpr("paper_id", "version", "CASE WHEN k % 7 = 3 THEN NULL ELSE paper_id END AS told")
    return E.identity_errors(artifacts, rows.selectExpr("paper_id", "CASE WHEN k % 11 = 4 THEN 'another' ELSE paper_id END AS bundle"))


LOOKS = "SELECT DISTINCT o_custkey AS packet, CASE WHEN o_custkey % 11 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN o_custkey % 13 = 0 THEN 'failed' ELSE 'complete' END AS status, 'x' AS packet_sha, CASE WHEN o_custkey % 17 = 0 THEN 'y' ELSE 'x' END AS expected_sha FROM orders"
PICKED = "SELECT o_custkey AS packet, CAST(o_orderkey AS VARCHAR(20)) AS id FROM orders WHERE o_orderkey % 5 <> 0"
RESULTS = """SELECT o_custkey AS packet, CAST(CASE WHEN o_orderkey % 29 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS VARCHAR(20)) AS id, CASE o_orderkey % 6 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'narrowed' WHEN 2 THEN 'rejected' WHEN 3 THEN 'unresolved' WHEN 4 THEN 'odd' ELSE 'confirmed' END AS outcome,
 'r' AS reason, 'a' AS strongest_alternative, CASE WHEN o_orderkey % 23 = 0 THEN ' ' ELSE 'o' END AS observation, 'd' AS diagnosis, 'm' AS remedy, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE 'faithful' END AS editor_fidelity, CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE 'e' END AS editor_reason,
 CASE WHEN o_orderkey % 7 = 0 THEN 'left' END AS surviving_claim FROM orders WHERE o_orderkey % 7 <> 3"""
SEEN = """SELECT o_custkey AS packet, CAST(o_orderkey AS VARCHAR(20)) AS id, concat('O', CAST(o_orderkey % 10 AS VARCHAR(9))) AS object_id, CASE o_orderkey % 4 WHEN 0 THEN 'unresolved' ELSE 'text' END AS correspondence, CASE WHEN o_orderkey % 3 = 0 THEN 'no such words' ELSE 'word' END AS quote FROM orders WHERE o_orderkey % 8 <> 1"""


@query(f"""WITH v AS ({LOOKS}), p AS ({PICKED}), r AS ({RESULTS}), s AS ({SEEN}), h AS (SELECT packet, id, count(*) AS n, bool_or(correspondence = 'unresolved') AS o FROM s GROUP BY 1, 2),
x AS (SELECT r.*, count(*) OVER (PARTITION BY r.packet, r.id) AS times, coalesce(n, 0) AS n, coalesce(o, FALSE) AS o, p.id IS NOT NULL AS chosen FROM r LEFT JOIN h ON h.packet = r.packet AND h.id = r.id LEFT JOIN p ON p.packet = r.packet AND p.id = r.id),
e AS (SELECT packet, NULL AS subject, 'version' AS error FROM v WHERE version <> 1 UNION ALL SELECT packet, NULL, 'status' FROM v WHERE status <> 'complete' UNION ALL SELECT packet, NULL, 'packet' FROM v WHERE packet_sha <> expected_sha
 UNION ALL SELECT packet, id, 'outcome' FROM x WHERE outcome = 'odd' UNION ALL SELECT packet, id, 'not chosen' FROM x WHERE NOT chosen UNION ALL SELECT packet, id, 'duplicate' FROM x WHERE times > 1 UNION ALL SELECT packet, id, 'account' FROM x WHERE trim(observation) = ''
 UNION ALL SELECT packet, id, 'fidelity' FROM x WHERE editor_fidelity IS NULL UNION ALL SELECT packet, id, 'fidelity reason' FROM x WHERE editor_reason = '' UNION ALL SELECT packet, id, 'surviving claim' FROM x WHERE outcome = 'narrowed' AND surviving_claim IS NULL
 UNION ALL SELECT packet, id, 'evidence' FROM x WHERE outcome <> 'unresolved' AND n = 0 UNION ALL SELECT packet, id, 'unavailable evidence' FROM x WHERE outcome <> 'unresolved' AND o
 UNION ALL SELECT packet, id, 'missing' FROM p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.packet = p.packet AND r.id = p.id) UNION ALL SELECT packet, id, 'unknown object' FROM s WHERE object_id IN ('O8', 'O9')
 UNION ALL SELECT packet, id, 'quote' FROM s WHERE object_id NOT IN ('O8', 'O9') AND correspondence = 'text' AND (quote <> 'word' OR object_id IN ('O2', 'O3')))
SELECT DISTINCT * FROM e""")
def second_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second looks at chosen findings, held against their packets and evidence; two objects hold the word only within another."""
    data = Relations(spark, sf_dir)
    objects = spark.createDataFrame([(f"O{k}", "a wordy text" if k in (2, 3) else "one word of it") for k in range(8)], "object_id string, content string")
    return C.verification_errors(data.sql(LOOKS), data.sql(PICKED), data.sql(RESULTS), data.sql(SEEN), objects)


SELECTIONS = """SELECT DISTINCT concat('p', CAST(user_id AS VARCHAR(9))) AS paper_id, concat('p', CAST(CASE WHEN user_id % 13 = 0 THEN 0 ELSE user_id END AS VARCHAR(9))) AS about, CASE user_id % 5 WHEN 0 THEN 'poetry' ELSE 'theory' END AS paper_type,
 CASE user_id % 7 WHEN 0 THEN NULL ELSE 'high' END AS confidence, CASE user_id % 11 WHEN 0 THEN 'static' ELSE 'applicability' END AS mode FROM events"""
TOLD_OF = """SELECT DISTINCT concat('p', CAST(user_id AS VARCHAR(9))) AS paper_id, concat('r', CAST(n_nationkey AS VARCHAR(9))) AS name, CASE WHEN (user_id + n_nationkey) % 9 = 0 THEN ' ' ELSE 'why' END AS reason, (user_id + n_nationkey) % 2 = 0 AS selected FROM events JOIN nation ON (user_id + n_nationkey) % 4 < 3
UNION ALL SELECT DISTINCT concat('p', CAST(user_id AS VARCHAR(9))), 'r3', 'again', user_id % 2 = 0 FROM events"""


@query(f"""WITH s AS ({SELECTIONS}), t AS ({TOLD_OF}), c AS (SELECT paper_id, name, count(*) FILTER (selected) AS s, count(*) FILTER (NOT selected) AS k, bool_or(trim(reason) = '') AS bare, CAST(substr(name, 2) AS INT) AS n FROM t GROUP BY 1, 2),
e AS (SELECT paper_id, NULL AS subject, 'paper' AS error FROM s WHERE about <> paper_id UNION ALL SELECT paper_id, NULL, 'paper type' FROM s WHERE paper_type = 'poetry' UNION ALL SELECT paper_id, NULL, 'confidence' FROM s WHERE confidence IS NULL UNION ALL SELECT paper_id, NULL, 'mode' FROM s WHERE mode = 'static'
 UNION ALL SELECT paper_id, name, 'no reason' FROM c WHERE bare UNION ALL SELECT paper_id, name, 'mandatory' FROM c WHERE s > 0 AND n < 2 UNION ALL SELECT paper_id, name, 'not in roster' FROM c WHERE n < 2 OR n >= 20 OR n = 7 UNION ALL SELECT paper_id, name, 'selected twice' FROM c WHERE s > 1
 UNION ALL SELECT paper_id, name, 'skipped twice' FROM c WHERE k > 1 UNION ALL SELECT paper_id, name, 'selected and skipped' FROM c WHERE s > 0 AND k > 0
 UNION ALL SELECT s.paper_id, 'r' || n, 'unaccounted' FROM s, range(2, 20) r(n) WHERE n <> 7 AND (s.paper_id, 'r' || n) NOT IN (SELECT (paper_id, name) FROM t))
SELECT DISTINCT * FROM e""")
def selection_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections of optional raters, held against a roster of twenty of which two are mandatory and one is off."""
    data = Relations(spark, sf_dir)
    roster = spark.createDataFrame([(f"r{k}", k != 7, k >= 2) for k in range(20)], "name string, enabled boolean, optional boolean")
    return C.selection_errors(roster, data.sql(SELECTIONS), data.sql(TOLD_OF))


TOPICS = (
    "Regression coefficients reported for household income lack clustered standard errors throughout", "Bibliography omits several cited working papers published before nineteen ninety",
    "Equation derivation skips boundary conditions needed when marginal utility vanishes", "Sample construction drops migrant workers without explaining attrition patterns clearly",
)
ALIKE = f"""SELECT concat('paper-', CAST(CAST(floor(o_orderkey / 200) AS BIGINT) AS VARCHAR(20))) AS paper_id, CASE o_custkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS rater, o_orderkey AS id, o_orderstatus AS issue_class, CAST(o_custkey % 2 + 1 AS INT) AS page, o_orderkey % 4 AS topic,
 CAST(o_orderkey % 2 + 1 AS INT) AS tab, CASE WHEN o_custkey % 5 < 2 THEN 'increase' ELSE 'decrease' END AS way,
 concat(CASE o_orderkey % 4 {" ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(TOPICS))} END, ' in Table ', CAST(o_orderkey % 2 + 1 AS VARCHAR(9)), ', an ', CASE WHEN o_custkey % 5 < 2 THEN 'increase' ELSE 'decrease' END) AS summary, 'the claim' AS claim FROM orders"""


@query(f"""WITH f AS ({ALIKE}), n AS (SELECT *, row_number() OVER (PARTITION BY paper_id, issue_class, page, topic, tab, way, rater ORDER BY id) AS m FROM f),
g AS (SELECT *, min((page, rater, id)) OVER (PARTITION BY paper_id, issue_class, page, topic, tab, way, m) AS opens FROM n)
SELECT paper_id, id, issue_class || '-' || dense_rank() OVER (PARTITION BY paper_id, issue_class ORDER BY opens) AS cluster FROM g""")
def greedy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that are one, by the order-dependent greedy rule: alike are those of one topic, unless the rater, the page, the
    table or the direction forbids; so the n-th finding of each rater on a matter is in its n-th group."""
    return S.clusters(Relations(spark, sf_dir).sql(ALIKE))


_STEMS = f""" list_transform(list_filter(%s, lambda x: length(x) >= 2 AND x NOT IN ({', '.join(repr(x) for x in T.STOP_WORDS)})),
 lambda x: CASE WHEN length(x) > 6 AND x LIKE '%%ies' THEN left(x, length(x) - 3) || 'y' WHEN length(x) > 6 AND x LIKE '%%ing' THEN left(x, length(x) - 3)
 WHEN length(x) > 5 AND x LIKE '%%ed' THEN left(x, length(x) - 2) WHEN length(x) > 4 AND x LIKE '%%s' AND NOT regexp_matches(x, '(ss|is|us)$') THEN left(x, length(x) - 1) ELSE x END)"""
#: What findings say, with some texts that two raters give alike and some that differ in a word.
SAID = """SELECT concat('paper-', CAST(CAST(floor(conv_id / 5) AS BIGINT) AS VARCHAR(20))) AS paper_id, CASE turn % 2 WHEN 0 THEN 'claim' ELSE 'source' END AS issue_class, conv_id * 100 + turn AS id, concat(text, ' by ', role) AS summary, role AS claim
FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL UNION ALL
SELECT concat('paper-', CAST(CAST(floor(conv_id / 5) AS BIGINT) AS VARCHAR(20))), CASE turn % 2 WHEN 0 THEN 'claim' ELSE 'source' END, conv_id * 100 + turn + 50, concat(text, CASE WHEN turn % 3 = 0 THEN ' by ' ELSE ' and other words by ' END, role), role
FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND conv_id % 3 = 0"""


# All pairs of a class that share a stem, by joining every stem of every text.
@query(f"""WITH f AS ({SAID}), d AS (SELECT paper_id, issue_class, min(id) AS id, summary, claim FROM f GROUP BY ALL),
t AS (SELECT paper_id, issue_class, id, regexp_extract_all(lower(summary), '[a-z0-9]+(?:\\.[0-9]+)?') AS s, regexp_extract_all(lower(summary || ' ' || claim), '[a-z0-9]+(?:\\.[0-9]+)?') AS l FROM d),
w AS (SELECT paper_id, issue_class, id, 'short' AS kind, unnest({_STEMS % "s"}) AS token FROM t UNION ALL SELECT paper_id, issue_class, id, 'long', unnest({_STEMS % "l"}) FROM t),
c AS (SELECT paper_id, issue_class, id, kind, token, count(*) AS n FROM w GROUP BY ALL), m AS (SELECT paper_id, issue_class, id, kind, sqrt(sum(n * n)) AS norm FROM c GROUP BY ALL),
p AS (SELECT a.paper_id, a.issue_class, a.kind, a.id AS a, b.id AS b, sum(a.n * b.n) AS dot, count(*) AS shared FROM c a JOIN c b ON a.paper_id = b.paper_id AND a.issue_class = b.issue_class AND a.kind = b.kind AND a.token = b.token AND a.id < b.id GROUP BY ALL),
q AS (SELECT p.*, dot / (x.norm * y.norm) AS cosine FROM p JOIN m x ON p.paper_id = x.paper_id AND p.issue_class = x.issue_class AND p.kind = x.kind AND a = x.id JOIN m y ON p.paper_id = y.paper_id AND p.issue_class = y.issue_class AND p.kind = y.kind AND b = y.id)
SELECT paper_id, issue_class, a, b, round(coalesce(any_value(cosine) FILTER (kind = 'short'), 0), 6) AS short_cosine, CAST(coalesce(any_value(shared) FILTER (kind = 'short'), 0) AS BIGINT) AS short_shared,
 round(coalesce(any_value(cosine) FILTER (kind = 'long'), 0), 6) AS long_cosine, CAST(coalesce(any_value(shared) FILTER (kind = 'long'), 0) AS BIGINT) AS long_shared FROM q GROUP BY 1, 2, 3, 4
HAVING coalesce(any_value(shared) FILTER (kind = 'short'), 0) >= 4 OR coalesce(any_value(shared) FILTER (kind = 'long'), 0) >= 8""")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of findings that share enough stems to be alike, with their cosines."""
    pairs = W.stem_pairs(W.distinct_texts(Relations(spark, sf_dir).sql(SAID)))
    return pairs.withColumns({c: F.round(c, 6) for c in ("short_cosine", "long_cosine")})


#: The same findings with all that a record holds.
RECORDS = f"""SELECT a.*, CASE id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, CASE id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'yes' WHEN 2 THEN 'partially' WHEN 3 THEN 'cannot_verify' ELSE 'no' END AS assessment, CASE id % 5 WHEN 0 THEN 'high' WHEN 1 THEN NULL ELSE 'medium' END AS confidence,
 concat('c', CAST(id % 2 AS VARCHAR(9))) AS category, CASE WHEN id % 4 = 0 THEN NULL ELSE concat('q', CAST(id % 6 AS VARCHAR(9))) END AS quote, CASE WHEN id % 3 = 1 THEN '' ELSE 'seen' END AS evidence, CASE WHEN id % 5 = 2 THEN 'no data' END AS reason,
 CASE WHEN id % 2 = 0 THEN concat('fix ', CAST(id % 10 AS VARCHAR(9))) END AS fix, CASE WHEN id % 8 = 0 THEN '{{}}' END AS numeric_check, CAST(id % 3 AS INT) AS n_sources FROM ({ALIKE}) a"""


@query(f"""WITH f AS ({RECORDS}), n AS (SELECT *, row_number() OVER (PARTITION BY paper_id, issue_class, page, topic, tab, way, rater ORDER BY id) AS m FROM f),
o AS (SELECT *, min((page, rater, id)) OVER (PARTITION BY paper_id, issue_class, page, topic, tab, way, m) AS opens FROM n), g AS (SELECT *, issue_class || '-' || dense_rank() OVER (PARTITION BY paper_id, issue_class ORDER BY opens) AS cluster FROM o),
l AS (SELECT paper_id, cluster, list({{'r': rater, 'i': id, 's': severity, 'a': assessment, 'c': confidence, 'k': category, 'q': quote, 'p': page, 'e': evidence, 'v': reason, 'f': fix, 'x': numeric_check, 'n': n_sources, 't': summary}} ORDER BY page, rater, CAST(id AS VARCHAR)) AS l FROM g GROUP BY 1, 2)
SELECT paper_id, cluster, l[1].t AS finding_summary, l[1].q AS primary_quote, len(l) AS n, array_to_string(list_transform(l, lambda x: x.r || ':' || x.i), ';') AS sources,
 CASE WHEN len(list_filter(l, lambda x: x.s = 'high')) > 0 THEN 'high' WHEN len(list_filter(l, lambda x: x.s = 'medium')) > 0 THEN 'medium' ELSE 'low' END AS severity,
 CASE WHEN len(list_filter(l, lambda x: x.c IS DISTINCT FROM 'high')) > 0 THEN 'medium' ELSE 'high' END AS confidence,
 array_to_string(list_transform(list_sort(list_distinct(list_filter(list_transform(l, lambda x: x.a), lambda a: a IS NOT NULL))), lambda a: a || '=' || len(list_filter(l, lambda x: x.a = a))), ',') AS assessment_counts,
 CASE WHEN len(list_distinct(list_filter(list_transform(l, lambda x: x.a), lambda a: a IS NOT NULL))) <= 1 THEN 'agreed' ELSE 'mixed' END AS consensus,
 array_to_string(list_transform(list_sort(list_transform(list_distinct(list_transform(l, lambda x: x.p || '/' || coalesce(x.q, '-'))), lambda d: {{'at': list_position(list_transform(l, lambda x: x.p || '/' || coalesce(x.q, '-')), d), 'd': d}})), lambda x: x.d), ',') AS locations,
 array_to_string(list_transform(list_filter(l, lambda x: x.e <> ''), lambda x: x.i), ',') AS evidence, array_to_string(list_transform(list_filter(l, lambda x: x.v <> ''), lambda x: x.i), ',') AS reasons, array_to_string(list_transform(list_filter(l, lambda x: x.f <> ''), lambda x: x.f), ',') AS fixes,
 array_to_string(list_transform(list_filter(l, lambda x: x.x <> ''), lambda x: x.i), ',') AS numeric_checks, array_to_string(flatten(list_transform(l, lambda x: list_transform(range(1, x.n + 1), lambda k: x.i || '/s' || k))), ',') AS source_objects,
 array_to_string(list_transform(list_filter(l, lambda x: x.n > 0), lambda x: x.i), ',') AS links FROM l""")
def canonical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole records of the greedy clusters: lists, places, sources, links, counts of assessments and their consensus."""
    c, rows = F.col, Relations(spark, sf_dir).sql(RECORDS)
    sources = F.transform(F.slice(F.array(F.lit("s1"), F.lit("s2")), F.lit(1), c("n_sources")), lambda x: F.struct(x.alias("id"), F.lit("text").alias("type")))
    links = F.when(c("n_sources") > 0, F.array(F.struct(F.lit("supports").alias("relation"))))
    full = rows.select(
        "paper_id", "rater", "id", "issue_class", "category", F.lit("manuscript_issue").alias("issue_type"), c("summary").alias("finding_summary"), c("claim").alias("claim_text"), c("evidence").alias("evidence_summary"),
        "severity", "assessment", "confidence", c("reason").alias("cannot_verify_reason"), c("fix").alias("suggested_fix"), "numeric_check", F.struct("page", c("quote").alias("text_quote")).alias("location"), sources.alias("source_objects"), links.alias("links"),
    )
    out = R.canonical_findings(full.join(S.clusters(rows), ["paper_id", "id"]), ["paper_id", "cluster"])
    ids = lambda part: F.array_join(F.transform(part, lambda x: x["id"].cast("string")), ",")
    return out.select(
        "paper_id", "cluster", "finding_summary", "primary_quote", F.size("sources").cast("long").alias("n"), F.array_join(F.transform("sources", lambda x: F.concat_ws(":", x["rater"], x["id"])), ";").alias("sources"), "severity", "confidence",
        F.array_join(F.transform(F.map_entries("assessment_counts"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("assessment_counts"), "consensus",
        F.array_join(F.transform("locations", lambda x: F.concat_ws("/", x["page"].cast("string"), F.coalesce(x["text_quote"], F.lit("-")))), ",").alias("locations"), ids("evidence").alias("evidence"), ids("reasons").alias("reasons"),
        F.array_join(F.transform("fixes", lambda x: x["text"]), ",").alias("fixes"), ids("numeric_checks").alias("numeric_checks"),
        F.array_join(F.transform("source_objects", lambda x: F.concat(x["id"].cast("string"), F.lit("/"), x["source_object"]["id"])), ",").alias("source_objects"), ids("links").alias("links"),
    )


@query(r"""SELECT p_partkey, 'table:' || (p_partkey % 30 + 1) || ';equation:' || (p_size % 9 + 1) || 'a;question:' || (p_size % 7 + 1) AS places,
CASE WHEN p_size % 3 = 0 THEN '-' ELSE '' END || (p_partkey % 90 + 10) || '.5%;' || (p_size + 1000) || 'pp' AS numbers, CASE WHEN p_size % 2 = 0 THEN 'up' ELSE 'down' END AS directions FROM part""")
def said_in_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, numbers and directions that texts tell; formulas' factors and numbers of places are none."""
    c = F.col
    size, key = c("p_size").cast("long"), c("p_partkey")
    text = F.concat(
        F.lit("See Tables "), (key % 30 + 1).cast("string"), F.lit(" and eq. ("), (size % 9 + 1).cast("string"), F.lit("A), Q"), (size % 7 + 1).cast("string"), F.lit(": it "), F.when(size % 2 == 0, "rises").otherwise("declines"),
        F.lit(" by "), F.when(size % 3 == 0, "−").otherwise(""), (key % 90 + 10).cast("string"), F.lit(".50 percent, 3 + x, not 2SLS, or 1,"), F.lpad((size % 1000).cast("string"), 3, "0"), F.lit(".0 percentage points."),
    )
    rows = S.with_said(Relations(spark, sf_dir).table("part").select("p_partkey", text.alias("text")), "text", "s")
    join = lambda k, f: F.array_join(F.transform(F.col(f"s.{k}"), f), ";")
    return rows.select(
        "p_partkey", join("places", lambda x: F.concat_ws(":", x["key"], x["item"])).alias("places"), join("numbers", lambda x: F.concat(F.coalesce(x["item"], F.lit("")), x["key"])).alias("numbers"),
        F.array_join("s.directions", ",").alias("directions"),
    )


_OPERATIONS = ("sum", "mean", "product", "difference", "percentage_points", "ratio", "percent_change")


@query(r"""WITH q AS (SELECT o_orderkey AS k, o_orderkey % 7 AS op, CAST(o_orderkey % 40 - 5 AS DOUBLE) AS a, 0.5 AS ha, CAST(o_custkey % 30 - 3 AS DOUBLE) AS b, 0.25 AS hb, CAST(o_orderkey % 5 AS DOUBLE) AS off, o_custkey % 2 = 0 AS pct FROM orders),
n AS (SELECT *, op IN (4, 6) OR (op IN (2, 5) AND pct) AS share, a - ha AS al, a + ha AS ah, b - hb AS bl, b + hb AS bh FROM q),
u AS (SELECT *, CASE WHEN share THEN 100.0 ELSE 1.0 END AS s FROM n), v AS (SELECT k, op, off, s, a / s AS a, al / s AS al, ah / s AS ah, b / s AS b, bl / s AS bl, bh / s AS bh FROM u),
r AS (SELECT *, op IN (5, 6) AND bl <= 0 AND bh >= 0 AS zero, CASE op WHEN 0 THEN a + b WHEN 1 THEN (a + b) / 2 WHEN 2 THEN a * b WHEN 3 THEN a - b WHEN 4 THEN a - b WHEN 5 THEN a / nullif(b, 0) ELSE a / nullif(b, 0) - 1 END AS mid,
 CASE op WHEN 0 THEN al + bl WHEN 1 THEN (al + bl) / 2 WHEN 2 THEN least(al * bl, al * bh, ah * bl, ah * bh) WHEN 3 THEN al - bh WHEN 4 THEN al - bh WHEN 5 THEN least(al / bl, al / bh, ah / bl, ah / bh) ELSE least(al / bl, al / bh, ah / bl, ah / bh) - 1 END AS low,
 CASE op WHEN 0 THEN ah + bh WHEN 1 THEN (ah + bh) / 2 WHEN 2 THEN greatest(al * bl, al * bh, ah * bl, ah * bh) WHEN 3 THEN ah - bl WHEN 4 THEN ah - bl WHEN 5 THEN greatest(al / bl, al / bh, ah / bl, ah / bh) ELSE greatest(al / bl, al / bh, ah / bl, ah / bh) - 1 END AS high FROM v)
SELECT k, CASE WHEN zero THEN 'unresolved' WHEN low * s <= x + 0.5 AND x - 0.5 <= high * s THEN 'rounding_compatible' ELSE 'arithmetic_discrepancy' END AS status, CASE WHEN NOT zero THEN round(low * s, 6) END AS low, CASE WHEN NOT zero THEN round(high * s, 6) END AS high
FROM (SELECT *, floor(mid * s) + off AS x FROM r)""")
def interval_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all seven operations over rounded quantities, on numbers and on per cents, with some that are off."""
    c = F.col
    rows = Relations(spark, sf_dir).table("orders").select(
        c("o_orderkey").alias("k"), F.element_at(F.array(*map(F.lit, _OPERATIONS)), (c("o_orderkey") % 7 + 1).cast("int")).alias("op"), (c("o_orderkey") % 40 - 5).alias("a"), (c("o_custkey") % 30 - 3).alias("b"),
        (c("o_orderkey") % 5).alias("off"), (c("o_custkey") % 2 == 0).alias("pct"),
    )
    share = c("op").isin("percentage_points", "percent_change") | (c("op").isin("product", "ratio") & c("pct"))
    scale = F.when(share, "percent").otherwise("number")
    by = F.when(share, 100.0).otherwise(1.0)
    a, b = c("a") / by, c("b") / by
    plain = {"sum": a + b, "mean": (a + b) / 2, "product": a * b, "difference": a - b, "percentage_points": a - b, "ratio": F.try_divide(a, b), "percent_change": F.try_divide(a, b) - 1}
    middle = F.coalesce(*[F.when(c("op") == k, v) for k, v in plain.items()], F.lit(0.0)) * by
    quantity = lambda value, half: F.struct(
        value.alias("value"), F.lit("q").alias("source_id"), F.lit("u").alias("unit"), F.lit("s").alias("sample"), F.lit("d").alias("denominator"), F.lit("c").alias("context"), scale.alias("scale"), F.lit(half).alias("rounding_half_width"),
    )
    said = quantity((F.floor(middle) + c("off")).cast("string"), "0.5")
    inputs = F.array(quantity(c("a").cast("string"), "0.5"), quantity(c("b").cast("string"), "0.25"))
    computed = F.format_string("%.9f", middle)
    check = F.struct(F.lit("arithmetic").alias("kind"), c("op").alias("operation"), inputs.alias("quantities"), said.alias("reported"), computed.alias("computed_value"), F.lit("0.00001").alias("tolerance"))
    # The tolerance covers the nine decimals of the declared value.
    out = spread(rows, "k").select("k", check.cast(A.CHECK).alias("check")).select("k", A.verdicts(c("check")).alias("v"))
    return out.select("k", "v.status", F.round(F.col("v.low").cast("double"), 6).alias("low"), F.round(F.col("v.high").cast("double"), 6).alias("high"))


CONFIGS = "SELECT c_custkey AS config, CASE WHEN c_custkey % 11 = 0 THEN 2 ELSE 1 END AS format, CAST(c_custkey % 13 AS INT) AS repeats, CAST(c_custkey % 150 AS DOUBLE) AS timeout_minutes FROM customer"
ITEMS = """SELECT c_custkey AS config, CASE WHEN n_nationkey % 2 = 0 THEN 'profile' ELSE 'case' END AS kind, CASE WHEN c_custkey % 17 = 0 THEN 'Bad_id' WHEN c_custkey % 19 = 0 THEN 'x' ELSE concat('x-', CAST(n_nationkey AS VARCHAR(9))) END AS id, CASE WHEN c_custkey % 23 = 0 THEN ' ' ELSE 'm' END AS model,
 CASE WHEN c_custkey % 29 = 0 THEN 'extreme' ELSE 'high' END AS effort, CASE c_custkey % 31 WHEN 0 THEN '' WHEN 1 THEN 'a,a' ELSE 'a,b' END AS role_names, 'p' AS pdf_sha, CASE WHEN c_custkey % 37 = 0 THEN 'q' ELSE 'p' END AS parsed_sha FROM customer JOIN nation ON n_nationkey < c_custkey % 5"""
REFERENCES = """SELECT c_custkey AS config, 'c' AS "case", concat('k', CAST(CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE n_nationkey END AS VARCHAR(9))) AS issue_key, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 's' END AS source, CASE WHEN c_custkey % 12 = 0 THEN '' ELSE 'a' END AS role_names, CAST(c_custkey % 8 AS DOUBLE) AS weight,
 CASE WHEN n_nationkey = 2 THEN 'open' ELSE 'confirmed' END AS status FROM customer JOIN nation ON n_nationkey < 3"""


@query(f"""WITH c AS ({CONFIGS}), i AS (SELECT *, count(*) OVER (PARTITION BY config, kind, id) AS n FROM ({ITEMS})), t AS (SELECT *, count(*) OVER (PARTITION BY config, issue_key) AS n FROM ({REFERENCES}) WHERE status = 'confirmed'),
e AS (SELECT config, NULL AS subject, 'format' AS error FROM c WHERE format <> 1 UNION ALL SELECT config, NULL, 'repeats' FROM c WHERE repeats NOT BETWEEN 1 AND 10 UNION ALL SELECT config, NULL, 'timeout' FROM c WHERE timeout_minutes <= 0 OR timeout_minutes > 120
 UNION ALL SELECT config, NULL, 'nothing to compare' FROM c WHERE config NOT IN (SELECT config FROM i WHERE kind = 'profile') OR config NOT IN (SELECT config FROM i WHERE kind = 'case')
 UNION ALL SELECT config, id, 'identifier' FROM i WHERE id = 'Bad_id' UNION ALL SELECT config, id, 'duplicate' FROM i WHERE n > 1 UNION ALL SELECT config, id, 'model' FROM i WHERE kind = 'profile' AND model = ' ' UNION ALL SELECT config, id, 'effort' FROM i WHERE kind = 'profile' AND effort = 'extreme'
 UNION ALL SELECT config, id, 'roles' FROM i WHERE kind = 'case' AND role_names IN ('', 'a,a') UNION ALL SELECT config, id, 'source' FROM i WHERE kind = 'case' AND pdf_sha <> parsed_sha
 UNION ALL SELECT config, issue_key, 'reference repeated' FROM t WHERE n > 1 UNION ALL SELECT config, issue_key, 'reference scope' FROM t WHERE source = '' OR role_names = '' UNION ALL SELECT config, issue_key, 'weight' FROM t WHERE weight <= 0 OR weight > 5)
SELECT DISTINCT * FROM e""")
def config_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark plans held against their rules."""
    data = Relations(spark, sf_dir)
    roles = F.filter(F.split("role_names", ","), lambda x: x != "")
    truth = data.sql(REFERENCES.replace('"case"', "`case`")).withColumn("roles", roles)
    return B.config_errors(data.sql(CONFIGS), data.sql(ITEMS).withColumn("roles", roles), truth)


COSTS = """SELECT event_id AS job, CASE WHEN event_id % 5 = 0 THEN concat('{"usage": {"input_tokens": ', CAST(event_id AS VARCHAR(20)), ', "output_tokens": 3}}') WHEN event_id % 7 = 0 THEN 'oops' ELSE concat('{"usage": {"input_tokens": ', CAST(CASE WHEN event_id % 11 = 0 THEN -1 ELSE event_id % 500 END AS VARCHAR(20)),
 ', "cache_read_input_tokens": ', CAST(event_id % 90 AS VARCHAR(20)), ', "cache_creation_input_tokens": ', CAST(event_id % 40 AS VARCHAR(20)), ', "output_tokens": ', CAST(event_id % 60 AS VARCHAR(20)), '}}') END AS document FROM events"""


@query("""SELECT event_id AS job, CASE WHEN ok THEN 'reported' ELSE 'unavailable' END AS status, CASE WHEN ok THEN event_id % 500 END AS input_uncached, CASE WHEN ok THEN event_id % 90 END AS input_cached, CASE WHEN ok THEN event_id % 40 END AS input_cache_write, CASE WHEN ok THEN event_id % 60 END AS output,
 CASE WHEN ok THEN event_id % 500 + event_id % 90 + event_id % 40 END AS input_total FROM (SELECT event_id, event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 AS ok FROM events)""")
def cost_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of the second log form, one document a job."""
    return B.cost_usage(Relations(spark, sf_dir).sql(COSTS))
