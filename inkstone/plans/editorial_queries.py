"""Queries on coverage ledgers, editorial decisions and reports, with their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coverage as V
from ..operators import editorial as E
from ..sources.views import Relations
from .registry import query

_PAPER = "concat('paper-', CAST(CAST(floor({k} / {n}) AS BIGINT) AS VARCHAR(20)))"
_RATERS = "CASE {k} % 4 WHEN 0 THEN 'claim_evidence_auditor' WHEN 1 THEN 'numerical_auditor' WHEN 2 THEN 'theory_logic_auditor' ELSE 'grammar_auditor' END"

#: Objects of papers of twenty parts: pages, tables' text, figures' text, cells.
OBJECTS = f"""SELECT {_PAPER.format(k="p_partkey", n=20)} AS paper_id, concat('OBJ-', CAST(p_partkey AS VARCHAR(20))) AS id, CAST(p_size % 5 + 1 AS INT) AS page,
 CASE p_partkey % 5 WHEN 4 THEN 'table_cell' ELSE 'text_span' END AS kind,
 CASE p_partkey % 5 WHEN 0 THEN 'pages/page_1.txt' WHEN 1 THEN 'tables/table_1.md' WHEN 2 THEN 'figures/figure_1.txt' WHEN 3 THEN 'tables/table_1.csv' ELSE 'tables/table_1.csv' END AS path FROM part"""
EQUATIONS = f"""SELECT {_PAPER.format(k="p_partkey", n=20)} AS paper_id, CAST(p_size % 6 + 1 AS INT) AS page, CASE p_partkey % 3 WHEN 0 THEN 'Equation' WHEN 1 THEN 'Eq.' ELSE 'Table' END AS kind,
 CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size % 4 AS VARCHAR(9)) END AS label FROM part"""
ROSTER = f"SELECT DISTINCT {_PAPER.format(k='p_partkey', n=20)} AS paper_id, {_RATERS.format(k='p_size')} AS rater FROM part"
ASSIGNED = f"""objects AS ({OBJECTS}), cited AS ({EQUATIONS}), roster AS ({ROSTER}),
assigned AS (SELECT paper_id, rater, 'assigned_remit' AS item_id, CAST([] AS VARCHAR[]) AS object_ids FROM roster
 UNION ALL SELECT r.paper_id, rater, 'display:' || o.id, [o.id] FROM roster r JOIN objects o ON r.paper_id = o.paper_id WHERE rater = 'numerical_auditor' AND kind = 'text_span' AND (path LIKE 'tables/%.md' OR path LIKE 'figures/%.txt')
 UNION ALL SELECT r.paper_id, rater, 'equation:' || e.page || ':' || e.label, coalesce((SELECT list(DISTINCT o.id ORDER BY o.id) FROM objects o WHERE o.paper_id = e.paper_id AND o.page = e.page AND path LIKE 'pages/%'), CAST([] AS VARCHAR[]))
  FROM roster r JOIN (SELECT DISTINCT paper_id, page, coalesce(label, 'equation') AS label FROM cited WHERE kind IN ('Equation', 'Eq.')) e ON r.paper_id = e.paper_id WHERE rater = 'theory_logic_auditor')"""


def _assigned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    data = Relations(spark, sf_dir)
    objects = data.sql(OBJECTS)
    return V.assigned(data.sql(ROSTER), objects, data.sql(EQUATIONS)), objects


@query(f"WITH {ASSIGNED} SELECT paper_id, rater, item_id, array_to_string(object_ids, ',') AS object_ids FROM assigned")
def coverage_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rater must cover: the remit, every display for some, every cited equation for others."""
    assigned, _ = _assigned(spark, sf_dir)
    return assigned.withColumn("object_ids", F.array_join("object_ids", ","))


#: Records of all items of even length and of claims; lists as text.
RECORDS = f"""SELECT {_PAPER.format(k="l_partkey", n=20)} AS paper_id, {_RATERS.format(k="l_suppkey")} AS rater,
 CASE l_linenumber % 4 WHEN 0 THEN 'assigned_remit' WHEN 1 THEN concat('claim:', CAST(l_orderkey % 9 AS VARCHAR(9))) WHEN 2 THEN concat('display:OBJ-', CAST(l_partkey AS VARCHAR(20))) ELSE concat('other-', CAST(l_orderkey % 3 AS VARCHAR(9))) END AS item_id,
 CASE l_orderkey % 6 WHEN 0 THEN 'linked_finding' WHEN 1 THEN 'cannot_verify' WHEN 2 THEN 'not_applicable' WHEN 3 THEN 'not_checked' ELSE 'checked' END AS status,
 CASE WHEN l_suppkey % 3 = 0 THEN NULL WHEN l_suppkey % 3 = 1 THEN ' ' ELSE 'a claim' END AS claim, CASE WHEN l_partkey % 5 < 3 THEN concat('OBJ-', CAST(l_partkey AS VARCHAR(20))) WHEN l_partkey % 5 = 3 THEN '' ELSE 'OBJ-none' END AS objects,
 CASE WHEN l_quantity < 25 THEN 'some reason' ELSE '' END AS reason, l_linenumber <> 3 AS attempted, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE 'looked' END AS check_performed,
 CASE WHEN l_orderkey % 5 = 0 THEN 'central' ELSE 'peripheral' END AS importance, CASE WHEN l_orderkey % 12 = 0 THEN concat('F-', CAST(l_suppkey % 4 AS VARCHAR(9))) ELSE '' END AS findings,
 CASE WHEN l_linenumber = 2 THEN 'sampled' ELSE 'full' END AS scope FROM lineitem"""
COMPLETION = f"""SELECT paper_id, rater, CASE WHEN length(paper_id) % 2 = 0 THEN 'complete' WHEN rater = 'grammar_auditor' THEN 'not_applicable' ELSE 'partial' END AS state FROM ({ROSTER}) r"""
NOTED = f"SELECT paper_id, rater, concat('F-', CAST(n_nationkey AS VARCHAR(9))) AS id FROM ({ROSTER}) r JOIN nation ON n_nationkey < 3"
_LIST = "list_filter(string_split({c}, ','), lambda x: x <> '')"


@query(f"""WITH {ASSIGNED}, records AS (SELECT * REPLACE ({_LIST.format(c="objects")} AS objects, {_LIST.format(c="findings")} AS findings) FROM ({RECORDS})), completion AS ({COMPLETION}), noted AS ({NOTED}),
r AS (SELECT r.*, a.object_ids AS need, a.item_id IS NOT NULL AS required, c.state FROM records r LEFT JOIN assigned a USING (paper_id, rater, item_id) LEFT JOIN completion c USING (paper_id, rater)),
e AS (SELECT paper_id, rater, item_id, 'unknown item' AS error FROM r WHERE NOT required AND NOT (item_id LIKE 'claim:%' AND (trim(coalesce(claim, '')) <> '' OR (status = 'not_applicable' AND claim IS NULL)))
 UNION ALL SELECT paper_id, rater, item_id, 'assigned objects omitted' FROM r WHERE required AND NOT list_has_all(objects, need)
 UNION ALL SELECT paper_id, rater, item_id, 'claim without evidence' FROM r WHERE item_id LIKE 'claim:%' AND len(objects) = 0
 UNION ALL SELECT paper_id, rater, item_id, 'exclusion without reason' FROM r WHERE status IN ('cannot_verify', 'not_applicable', 'not_checked') AND reason = ''
 UNION ALL SELECT paper_id, rater, item_id, 'not attempted' FROM r WHERE status <> 'not_checked' AND (NOT attempted OR check_performed IS NULL)
 UNION ALL SELECT paper_id, rater, item_id, 'contradicts completion' FROM r WHERE state IN ('complete', 'not_applicable') AND (required OR importance = 'central') AND status = 'not_checked'
 UNION ALL SELECT paper_id, rater, item_id, 'finding link' FROM r WHERE (status = 'linked_finding') <> (len(findings) > 0)
 UNION ALL SELECT paper_id, rater, item_id, 'sample without reason' FROM r WHERE scope = 'sampled' AND reason = ''
 UNION ALL SELECT r.paper_id, rater, item_id, 'unknown object' FROM (SELECT *, unnest(objects) AS o FROM r) r WHERE NOT EXISTS (SELECT 1 FROM objects x WHERE x.paper_id = r.paper_id AND x.id = o)
 UNION ALL SELECT r.paper_id, rater, item_id, 'unknown finding' FROM (SELECT *, unnest(findings) AS f FROM r) r WHERE NOT EXISTS (SELECT 1 FROM noted x WHERE x.paper_id = r.paper_id AND x.rater = r.rater AND x.id = f)
 UNION ALL SELECT paper_id, rater, item_id, 'duplicate item' FROM records GROUP BY 1, 2, 3 HAVING count(*) > 1
 UNION ALL SELECT paper_id, rater, item_id, 'unaddressed' FROM assigned WHERE (paper_id, rater, item_id) NOT IN (SELECT (paper_id, rater, item_id) FROM records) AND (paper_id, rater) IN (SELECT (paper_id, rater) FROM records)
 UNION ALL SELECT paper_id, rater, NULL, 'no ledger' FROM completion WHERE (paper_id, rater) NOT IN (SELECT (paper_id, rater) FROM records)
 UNION ALL SELECT paper_id, rater, NULL, 'no central claim' FROM completion c WHERE rater = 'claim_evidence_auditor' AND state = 'complete' AND (paper_id, rater) IN (SELECT (paper_id, rater) FROM records)
  AND NOT EXISTS (SELECT 1 FROM records r WHERE r.paper_id = c.paper_id AND r.rater = c.rater AND item_id LIKE 'claim:%' AND trim(coalesce(claim, '')) <> '' AND importance = 'central' AND status <> 'not_applicable'))
SELECT DISTINCT * FROM e""")
def coverage_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledgers held against what was assigned, known objects and findings, and the claimed completion."""
    data = Relations(spark, sf_dir)
    required, objects = _assigned(spark, sf_dir)
    listed = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    records = data.sql(RECORDS).withColumn("source_object_ids", listed("objects")).withColumn("finding_ids", listed("findings"))
    return V.coverage_errors(records, required, objects, data.sql(NOTED), data.sql(COMPLETION))


#: Findings, blocks, decisions and checks of papers of forty findings.
_CANON = "concat('CANON-', lpad(CAST({k} AS VARCHAR(9)), 3, '0'))"
_ORDER_PAPER = _PAPER.format(k="o_orderkey", n=40)
FINDINGS = f"""SELECT {_ORDER_PAPER} AS paper_id, {_CANON.format(k="o_orderkey % 40 + 1")} AS canonical_id, o_orderkey AS place, CASE o_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity,
 CASE o_custkey % 4 WHEN 0 THEN 'manuscript_issue' WHEN 1 THEN 'copyedit_issue' WHEN 2 THEN 'cannot_verify' ELSE 'parser_artifact' END AS issue_class, concat(o_orderstatus, '|', o_orderpriority) AS finding_summary,
 concat('claims:NA-', lpad(CAST(o_orderkey % 40 + 1 AS VARCHAR(9)), 3, '0')) AS source FROM orders"""
BLOCKS = f"""SELECT {_ORDER_PAPER} AS paper_id, CAST(o_orderkey % 40 AS INT) AS place, CASE WHEN o_custkey % 13 = 0 THEN 'Bad!' WHEN o_custkey % 17 = 0 THEN 'b1' ELSE concat('b', CAST(o_orderkey % 40 AS VARCHAR(9))) END AS id,
 CASE WHEN o_custkey % 19 = 0 THEN '# Odd' WHEN o_custkey % 23 = 0 THEN 'Appendix: Traceability Map' WHEN o_orderkey % 40 < 3 THEN 'Summary' ELSE 'Appendix: Notes' END AS section,
 CASE o_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN concat('Text', chr(10), '# A heading') WHEN 2 THEN concat('| a | b |', chr(10), '| - | --- |') WHEN 3 THEN concat('| a | b |', chr(10), '| --- | :--: |', chr(10), '| c | d |')
  WHEN 4 THEN concat('A line', chr(10), '----') WHEN 5 THEN '| alone |' ELSE 'Plain words.' END AS markdown FROM orders WHERE o_orderkey % 40 < 6"""
DECISIONS = f"""SELECT {_ORDER_PAPER} AS paper_id, {_CANON.format(k="o_orderkey % 40 + 1")} AS canonical_id, o_orderkey AS place,
 CASE o_custkey % 6 WHEN 0 THEN 'included' WHEN 1 THEN 'narrowed' WHEN 2 THEN 'appendix_only' WHEN 3 THEN 'rejected' WHEN 4 THEN 'merged' ELSE CASE WHEN o_custkey % 5 = 0 THEN 'kept' ELSE 'merged' END END AS disposition,
 CASE WHEN o_custkey % 29 = 0 THEN ' ' ELSE 'because' END AS reason, CASE WHEN o_custkey % 6 > 3 THEN '' WHEN o_custkey % 6 = 3 THEN CASE WHEN o_custkey % 9 = 0 THEN 'b2' ELSE '' END WHEN o_custkey % 11 = 0 THEN 'b1,b1' WHEN o_custkey % 31 = 0 THEN 'zz' ELSE concat('b', CAST(o_custkey % 6 * 2 AS VARCHAR(9))) END AS blocks,
 CASE WHEN o_custkey % 6 < 3 AND o_custkey % 8 <> 0 THEN concat('Treated ', CAST(o_orderkey % 40 AS VARCHAR(9)), '. ') WHEN o_custkey % 33 = 3 THEN 'why' ELSE '' END AS treatment,
 CASE WHEN o_custkey % 6 > 3 THEN CASE WHEN o_custkey % 16 = 0 THEN 'CANON-999' WHEN o_custkey % 14 = 0 THEN {_CANON.format(k="o_orderkey % 40 + 1")} ELSE {_CANON.format(k="(o_orderkey + 1) % 40 + 1")} END WHEN o_custkey % 37 = 0 THEN 'CANON-001' END AS destination,
 CASE WHEN o_custkey % 10 < 5 THEN 'this' END AS surviving_claim, CASE WHEN o_custkey % 12 < 9 THEN 'kept' ELSE '' END AS retained_evidence, CASE WHEN o_custkey % 15 < 12 THEN 'with care' END AS qualifications
FROM orders WHERE o_orderkey % 17 <> 0"""
VERDICTS = f"""SELECT {_ORDER_PAPER} AS paper_id, {_CANON.format(k="o_orderkey % 43 + 1")} AS canonical_id, CASE WHEN o_custkey % 9 = 0 THEN 'unfaithful' ELSE 'faithful' END AS verdict, CASE WHEN o_custkey % 21 = 0 THEN '' ELSE 'read' END AS reason,
 CASE WHEN o_custkey % 25 = 0 THEN 'human' ELSE 'editor_model' END AS assessor FROM orders WHERE o_orderkey % 3 <> 0"""
_EDITORIAL = f"findings AS ({FINDINGS}), blocks AS ({BLOCKS}), decisions AS (SELECT * REPLACE ({_LIST.format(c='blocks')} AS blocks) FROM ({DECISIONS})), verdicts AS ({VERDICTS})"


def _prose(name: str, rows: str, subject: str, text: str) -> str:
    """A common table expression of the prose errors of a text column."""
    cells = lambda x: f"string_split(trim({x}, '|'), '|')"
    sound = f"""starts_with(coalesce(l[i + 1], ''), '|') AND len({cells("l[i]")}) = len({cells("l[i + 1]")}) AND len(list_filter({cells("l[i + 1]")}, lambda x: NOT regexp_matches(x, '^\\s*:?-{{3,}}:?\\s*$'))) = 0"""
    return rf"""{name} AS (SELECT paper_id, {subject} AS subject, 'boundary in prose' AS error FROM {rows} WHERE regexp_matches({text}, '(?m)^ {{0,3}}#{{1,2}}(\s|$)') OR regexp_matches({text}, '(^|\n)[^\s][^\n]*\n {{0,3}}(=+|-+)[ \t]*(\n|$)')
 UNION ALL SELECT paper_id, subject, 'table without delimiters' FROM (SELECT paper_id, {subject} AS subject, list_transform(string_split(coalesce({text}, ''), chr(10)), lambda x: trim(x)) AS l FROM {rows})
  WHERE len(list_filter(range(1, len(l) + 1), lambda i: starts_with(l[i], '|') AND NOT (i > 1 AND starts_with(l[i - 1], '|')) AND NOT ({sound}))) > 0)"""


@query(f"""WITH RECURSIVE {_EDITORIAL}, {_prose("p1", "blocks", "id", "markdown")}, {_prose("p2", "decisions", "canonical_id", "treatment")},
have AS (SELECT paper_id, list(DISTINCT id) AS ids, list(DISTINCT id) FILTER (starts_with(section, 'Appendix:')) AS appendix FROM blocks GROUP BY 1),
treated AS (SELECT DISTINCT paper_id, blocks[1] AS id FROM decisions WHERE disposition IN ('included', 'narrowed', 'appendix_only') AND len(blocks) = 1 AND trim(treatment) <> ''),
d AS (SELECT d.*, coalesce(ids, []) AS ids, coalesce(appendix, []) AS appendix, disposition IN ('included', 'narrowed', 'appendix_only') AS kept, count(*) OVER (PARTITION BY d.paper_id, canonical_id) AS times FROM decisions d LEFT JOIN have h ON d.paper_id = h.paper_id),
w AS (SELECT paper_id, canonical_id AS start, destination AS pos, 1 AS steps FROM decisions WHERE disposition = 'merged'
 UNION ALL SELECT w.paper_id, start, destination, steps + 1 FROM w JOIN decisions d ON d.paper_id = w.paper_id AND d.canonical_id = w.pos AND disposition = 'merged' WHERE steps < 90),
ends AS (SELECT w.paper_id, start, d.disposition FROM (SELECT paper_id, start, arg_max(pos, steps) AS pos FROM w GROUP BY 1, 2) w LEFT JOIN decisions d ON d.paper_id = w.paper_id AND d.canonical_id = w.pos),
e AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2
 UNION ALL SELECT paper_id, id, 'block id' FROM (SELECT *, count(*) OVER (PARTITION BY paper_id, id) AS n FROM blocks) WHERE n > 1 OR NOT regexp_matches(id, '^[a-z][a-z0-9_-]*$')
 UNION ALL SELECT paper_id, id, 'block section' FROM blocks WHERE section IN ('# Odd', 'Appendix: Traceability Map')
 UNION ALL SELECT paper_id, id, 'empty block' FROM blocks b WHERE markdown = '' AND (paper_id, id) NOT IN (SELECT (paper_id, id) FROM treated)
 UNION ALL SELECT paper_id, canonical_id, 'unknown disposition' FROM d WHERE disposition = 'kept' UNION ALL SELECT paper_id, canonical_id, 'no reason' FROM d WHERE trim(reason) = ''
 UNION ALL SELECT paper_id, canonical_id, 'block references' FROM d WHERE len(list_distinct(blocks)) < len(blocks) OR NOT list_has_all(ids, blocks)
 UNION ALL SELECT paper_id, canonical_id, 'no rendered treatment' FROM d WHERE kept AND (len(blocks) <> 1 OR trim(treatment) = '') UNION ALL SELECT paper_id, canonical_id, 'destination' FROM d WHERE kept AND destination IS NOT NULL
 UNION ALL SELECT paper_id, canonical_id, 'no appendix' FROM d WHERE disposition = 'appendix_only' AND NOT list_has_all(appendix, blocks)
 UNION ALL SELECT paper_id, canonical_id, 'no surviving claim' FROM d WHERE disposition = 'narrowed' AND surviving_claim IS NULL
 UNION ALL SELECT paper_id, canonical_id, 'rejected but treated' FROM d WHERE disposition = 'rejected' AND (len(blocks) > 0 OR destination IS NOT NULL OR treatment <> '')
 UNION ALL SELECT d.paper_id, d.canonical_id, 'merge destination' FROM d LEFT JOIN findings f ON f.paper_id = d.paper_id AND f.canonical_id = d.destination WHERE disposition = 'merged' AND (f.paper_id IS NULL OR d.destination = d.canonical_id)
 UNION ALL SELECT paper_id, canonical_id, 'merge account' FROM d WHERE disposition = 'merged' AND (retained_evidence = '' OR qualifications IS NULL)
 UNION ALL SELECT paper_id, start, CASE disposition WHEN 'merged' THEN 'cyclic merge' ELSE 'no retained destination' END FROM ends WHERE disposition IS NULL OR disposition IN ('merged', 'rejected')
 UNION ALL SELECT v.paper_id, v.canonical_id, 'unknown or duplicate check' FROM (SELECT *, count(*) OVER (PARTITION BY paper_id, canonical_id) AS n FROM verdicts) v LEFT JOIN findings f USING (paper_id, canonical_id) WHERE n > 1 OR f.place IS NULL
 UNION ALL SELECT paper_id, canonical_id, 'assessor' FROM verdicts WHERE reason = '' OR assessor <> 'editor_model' UNION ALL SELECT paper_id, canonical_id, 'not faithful' FROM verdicts WHERE verdict <> 'faithful'
 UNION ALL SELECT paper_id, canonical_id, 'no decision' FROM findings WHERE (paper_id, canonical_id) NOT IN (SELECT (paper_id, canonical_id) FROM decisions)
 UNION ALL SELECT paper_id, canonical_id, 'no check' FROM findings WHERE severity <> 'low' AND issue_class IN ('manuscript_issue', 'cannot_verify') AND (paper_id, canonical_id) NOT IN (SELECT (paper_id, canonical_id) FROM verdicts))
SELECT DISTINCT * FROM e""")
def decision_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editorial decisions on papers of forty findings, held against their findings, blocks, merges and checks."""
    data = Relations(spark, sf_dir)
    decisions = data.sql(DECISIONS).withColumn("block_ids", F.filter(F.split("blocks", ","), lambda x: x != ""))
    return E.decision_errors(data.sql(FINDINGS), data.sql(BLOCKS), decisions, data.sql(VERDICTS))


@query(f"""WITH RECURSIVE {_EDITORIAL}, o AS (SELECT b.*, CASE WHEN section IS DISTINCT FROM lag(section) OVER (PARTITION BY paper_id ORDER BY place) THEN '## ' || section || chr(10) || chr(10) ELSE '' END
  || CASE WHEN trim(markdown) <> '' THEN trim(markdown) || chr(10) || chr(10) ELSE '' END AS head FROM blocks b),
t AS (SELECT paper_id, id, string_agg(trim(treatment) || chr(10), chr(10) ORDER BY place) AS t FROM (SELECT paper_id, unnest(blocks) AS id, place, treatment FROM decisions) WHERE trim(treatment) <> '' GROUP BY 1, 2),
p AS (SELECT o.paper_id, place, rtrim(head || coalesce(t, ''), chr(10)) || chr(10) AS part FROM o LEFT JOIN t USING (paper_id, id) WHERE head || coalesce(t, '') <> ''),
body AS (SELECT paper_id, string_agg(part, chr(10) ORDER BY place) AS body FROM p GROUP BY 1),
w AS (SELECT paper_id, canonical_id AS start, destination AS pos, 1 AS steps FROM decisions WHERE disposition = 'merged'
 UNION ALL SELECT w.paper_id, start, destination, steps + 1 FROM w JOIN decisions d ON d.paper_id = w.paper_id AND d.canonical_id = w.pos AND disposition = 'merged' WHERE steps < 90),
ends AS (SELECT w.paper_id, start, d.canonical_id AS pos FROM (SELECT paper_id, start, arg_max(pos, steps) AS pos FROM w GROUP BY 1, 2) w JOIN decisions d ON d.paper_id = w.paper_id AND d.canonical_id = w.pos AND d.disposition NOT IN ('merged', 'rejected')),
rows AS (SELECT f.paper_id, f.place, '| ' || coalesce(b.section, 'Not included') || ' | ' || replace(finding_summary, '|', '\\|') || ' | ' || f.canonical_id || ' | ' || source || ' | ' || trim(regexp_replace(d.disposition || ': ' || d.reason, '\\s+', ' ', 'g')) || ' |' AS line
 FROM findings f JOIN decisions d USING (paper_id, canonical_id) LEFT JOIN ends e ON e.paper_id = f.paper_id AND e.start = f.canonical_id
 LEFT JOIN decisions g ON g.paper_id = f.paper_id AND g.canonical_id = coalesce(e.pos, f.canonical_id) LEFT JOIN blocks b ON b.paper_id = f.paper_id AND b.id = g.blocks[1]),
map AS (SELECT paper_id, string_agg(line, chr(10) ORDER BY place, line) AS lines FROM rows GROUP BY 1)
SELECT paper_id, '# Report' || chr(10) || chr(10) || coalesce(body || chr(10), '') || '## Appendix: Traceability Map' || chr(10) || chr(10) || '| Report section | Finding | Canonical ID | Source finding IDs | Disposition and evidence-based reason |'
 || chr(10) || '| --- | --- | --- | --- | --- |' || coalesce(chr(10) || lines, '') || chr(10) AS report FROM body FULL JOIN map USING (paper_id)""")
def editorial_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports that the decisions make: blocks, treatments, and a row of the map for each finding."""
    data = Relations(spark, sf_dir)
    decisions = data.sql(DECISIONS).withColumn("block_ids", F.filter(F.split("blocks", ","), lambda x: x != ""))
    return E.rendered_report(data.sql(FINDINGS).withColumn("source_ids", F.array("source")), data.sql(BLOCKS), decisions)


_NL = "chr(10)"
#: Reports of pages, with what such reports lack or have too much of, by the page's number.
REPORTS = f"""SELECT page_id AS report_id, concat('# Report', {_NL}, CASE WHEN page_id % 11 = 0 THEN '' ELSE concat('## Executive Summary', {_NL}, CASE WHEN page_id % 7 = 0 THEN '### Only' ELSE 'Words. ' END, {_NL}) END,
 CASE WHEN page_id % 13 = 0 THEN '' ELSE concat('## Suggested Revision Priorities', {_NL}, 'See ', url, ' for more.', {_NL}) END, '## Additional Findings', {_NL}, CASE WHEN page_id % 17 = 0 THEN 'As in CANON-001 above.' ELSE 'Other things.' END, {_NL},
 repeat('Many words. ', CASE WHEN page_id % 3 = 0 THEN 10 ELSE 200 END), {_NL}, CASE WHEN page_id % 19 = 0 THEN 'Report was saved.' ELSE '' END, {_NL}, CASE WHEN page_id % 5 = 0 THEN '' ELSE concat('## Review Configuration', {_NL}, 'All of it.', {_NL}) END,
 CASE WHEN page_id % 4 = 0 THEN concat('## Appendix: External Sources', {_NL}, '- ', url, {_NL}) ELSE '' END, CASE WHEN page_id % 6 = 0 THEN concat('## Appendix: Grammar and Copyediting Issues', {_NL}, 'None.', {_NL}) ELSE '' END,
 CASE WHEN page_id % 23 = 0 THEN '' ELSE concat('## Appendix: Traceability Map', {_NL}, {_NL}, '| Section | Canonical ID | Source finding IDs |', {_NL}, '| --- | --- | --- |', {_NL}, '| a | CANON-001 | claims:NA-001; numbers:NA-00', CAST(page_id % 3 AS VARCHAR(9)), ' |', {_NL},
  CASE WHEN page_id % 8 = 0 THEN '' WHEN page_id % 8 = 1 THEN concat('| b | CANON-002 CANON-003 | claims:NA-002 |', {_NL}) ELSE concat('| b | CANON-002 | claims:NA-002 |', {_NL}) END, CASE WHEN page_id % 9 = 0 THEN concat('| c | CANON-001 | claims:NA-001 |', {_NL}) ELSE '' END) END) AS report FROM pages"""
TOLD = """SELECT page_id AS report_id, concat('CANON-00', CAST(n_regionkey + 1 AS VARCHAR(9))) AS canonical_id, CASE WHEN page_id % 10 < 5 AND n_regionkey = 0 THEN 'copyedit_issue' ELSE 'manuscript_issue' END AS issue_class,
 CASE n_regionkey WHEN 0 THEN 'claims:NA-001,numbers:NA-001' ELSE 'claims:NA-002' END AS sources FROM pages JOIN (SELECT DISTINCT n_regionkey FROM nation WHERE n_regionkey < 2) n ON page_id % 29 <> 0"""
EVIDENCE = "SELECT page_id AS report_id, url FROM pages WHERE page_id % 12 <> 0"


def _part(heading: str) -> str:
    return rf"regexp_extract(report || chr(10) || '## ', '(?s)(## {heading}.*?)\n## ', 1)"


def _addresses(text: str) -> str:
    """Addresses of a text as this query's urls are: without white space, closing punctuation or brackets."""
    return rf"list_distinct(list_transform(regexp_extract_all({text}, 'https?://[^\s<>\"\]]+'), lambda u: regexp_replace(u, '[.,;:]+$', '')))"


_HEADED = ("Executive Summary", "Suggested Revision Priorities", "Additional Findings")
_RULES = {
    "too short": "any_found AND length(trim(report)) < 2000", "process note": "contains(report, 'Report was saved')", "no scope": "NOT contains(report, '## Review Configuration')",
    "no identifiers": "any_found AND NOT regexp_matches(report, 'CANON-[0-9]{3}|NA-[0-9]{3}')", "no Appendix: Traceability Map": "map = ''",
    "identifiers in body": "map <> '' AND regexp_matches(replace(report, map, ''), 'CANON-[0-9]{3}|[a-z]:NA-[0-9]{3}')", "no Appendix: Grammar and Copyediting Issues": "copyedit AND NOT contains(report, '## Appendix: Grammar')",
    **{f"no {h}": f"NOT contains(report, '## {h}')" for h in _HEADED},
    **{f"empty {h}": rf"contains(report, '## {h}') AND NOT regexp_matches({_part(h)}, '\n\s*[^#\s]')" for h in (*_HEADED, "Review Configuration", "Appendix: Traceability Map")},
}


@query(rf"""WITH r AS ({REPORTS}), t AS (SELECT * REPLACE (string_split(sources, ',') AS sources) FROM ({TOLD})), ev AS ({EVIDENCE}),
g AS (SELECT report_id, list(DISTINCT canonical_id) AS ids, list_distinct(flatten(list(sources))) AS sources, bool_or(issue_class = 'copyedit_issue') AS copyedit FROM t GROUP BY 1), u AS (SELECT report_id, list(DISTINCT url) AS urls FROM ev GROUP BY 1),
x AS (SELECT r.*, g.ids IS NOT NULL AS any_found, coalesce(ids, []) AS ids, coalesce(sources, []) AS sources, coalesce(copyedit, FALSE) AS copyedit, coalesce(urls, []) AS urls, {_part("Appendix: Traceability Map")} AS map, {_part("Appendix: External Sources")} AS ext
 FROM r LEFT JOIN g USING (report_id) LEFT JOIN u USING (report_id)),
l AS (SELECT report_id, unnest(string_split(map, chr(10))) AS line FROM x WHERE map <> ''), m AS (SELECT report_id, string_split(trim(line, '|'), '|') AS c FROM l WHERE line LIKE '|%' AND line NOT LIKE '| Section%' AND line NOT LIKE '| ---%'),
rows AS (SELECT report_id, regexp_extract_all(c[2], 'CANON-[0-9]{{3}}') AS ids, regexp_extract_all(c[3], '[a-z]+:NA-[0-9]{{3}}') AS told FROM m),
each AS (SELECT report_id, canonical_id, count(*) AS n, first(told) AS told FROM (SELECT report_id, told, unnest(ids) AS canonical_id FROM rows) GROUP BY 1, 2),
w AS (SELECT t.report_id, t.canonical_id, t.sources, coalesce(n, 0) AS n, told FROM t JOIN x ON x.report_id = t.report_id AND map <> '' LEFT JOIN each e ON e.report_id = t.report_id AND e.canonical_id = t.canonical_id),
f AS ({" UNION ALL ".join(f"SELECT report_id, '{name}' AS failure FROM x WHERE {rule}" for name, rule in _RULES.items())}
 UNION ALL SELECT report_id, 'unknown identifier: ' || i FROM (SELECT report_id, ids, unnest(list_distinct(regexp_extract_all(map, 'CANON-[0-9]{{3}}'))) AS i FROM x) WHERE NOT list_contains(ids, i)
 UNION ALL SELECT report_id, 'unknown source: ' || i FROM (SELECT report_id, sources, unnest(list_distinct(regexp_extract_all(map, '[a-z]+:NA-[0-9]{{3}}'))) AS i FROM x) WHERE NOT list_contains(sources, i)
 UNION ALL SELECT report_id, 'address not in evidence: ' || i FROM (SELECT report_id, urls, unnest({_addresses("report")}) AS i FROM x) WHERE NOT list_contains(urls, i)
 UNION ALL SELECT report_id, 'address not in appendix: ' || i FROM (SELECT report_id, urls, {_addresses("ext")} AS named, unnest({_addresses("CASE WHEN ext = '' THEN report ELSE replace(report, ext, '') END")}) AS i FROM x) WHERE list_contains(urls, i) AND NOT list_contains(named, i)
 UNION ALL SELECT report_id, 'row without one identifier' FROM rows WHERE len(ids) <> 1 UNION ALL SELECT report_id, 'not in the table: ' || canonical_id FROM w WHERE n = 0 UNION ALL SELECT report_id, 'several rows: ' || canonical_id FROM w WHERE n > 1
 UNION ALL SELECT report_id, 'source not in row: ' || canonical_id || ' ' || i FROM (SELECT *, unnest(sources) AS i FROM w WHERE n = 1) WHERE NOT list_contains(told, i)
 UNION ALL SELECT report_id, 'source of another row: ' || canonical_id || ' ' || i FROM (SELECT *, unnest(list_distinct(told)) AS i FROM w WHERE n = 1) WHERE NOT list_contains(sources, i))
SELECT DISTINCT * FROM f""")
def report_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports held against their findings and evidence."""
    data = Relations(spark, sf_dir)
    return E.report_failures(data.sql(REPORTS), data.sql(TOLD).withColumn("source_ids", F.split("sources", ",")), data.sql(EVIDENCE))
