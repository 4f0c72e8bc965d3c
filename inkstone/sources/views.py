"""Relations in the shape of papers' pages, boxes and findings, derived from plain tables by fixed expressions.

Each view is one SQL select that both engines read alike; no window, so a source that holds most rows is no bottleneck.
"""

import re

from pyspark.sql import DataFrame, SparkSession

NAMES = "CASE doc_id % 5 WHEN 0 THEN 'Becker' WHEN 1 THEN 'Brown' WHEN 2 THEN 'Clark' WHEN 3 THEN 'Davis' ELSE 'Evans' END"

#: Pages of papers of 40 pages: (paper_id, page, doc_id, text).
PAGES = """
SELECT concat('paper-', CAST(CAST(floor(doc_id / 40) AS BIGINT) AS VARCHAR(20))) AS paper_id, CAST(doc_id % 40 + 1 AS INT) AS page, doc_id, text
FROM documents WHERE doc_id IS NOT NULL"""

#: The same pages with lines that documents lack: headings and lines like them, captions, citations, cross-references, words
#: split over pages, reference lists.
_HEADINGS = ("I. Introduction", "A Data", "B.1 Proofs", "N 100 200", "Abstract", "", "THE MAIN RESULT", "iv. results", "10 Other Data", "12 men 13 Men", "Conclusion:", "A Panel B Panel")
_HEADING = " ".join(f"WHEN {k} THEN '{h}'" for k, h in enumerate(_HEADINGS) if h)
MARKED = f"""
SELECT paper_id, page, doc_id, concat(
  CASE WHEN page = 6 THEN concat('tions 4 and more', chr(10)) WHEN page = 8 THEN concat('ures 3 and on', chr(10)) ELSE '' END,
  CASE doc_id % 12 {_HEADING} ELSE concat(CAST(doc_id % 9 + 1 AS VARCHAR(9)), ' Data and Methods') END, chr(10),
  CASE WHEN doc_id % 24 = 5 THEN concat(chr(10), 'of the main sample', chr(10)) ELSE '' END,
  CASE doc_id % 4 WHEN 0 THEN 'Table ' WHEN 1 THEN 'Table ' WHEN 2 THEN 'Figure ' ELSE 'FIGURE ' END, CAST(doc_id % 9 + 1 AS VARCHAR(9)),
  CASE doc_id % 4 WHEN 0 THEN ': Summary of results' WHEN 3 THEN ' LARGE SUMS' ELSE '' END, chr(10), CASE WHEN doc_id % 8 = 2 THEN concat('Notes: drawn by hand', chr(10)) ELSE '' END,
  'See Figures ', CAST(doc_id % 7 + 1 AS VARCHAR(9)), ' and ', CAST(doc_id % 7 + 2 AS VARCHAR(9)), ' and Table A.', CAST(doc_id % 4 + 1 AS VARCHAR(9)), ', not Section (2b) or Eq. 3x.', chr(10),
  {NAMES}, ' (', CAST(1950 + doc_id % 70 AS VARCHAR(9)), ') finds 1,234.50 and -', CAST(doc_id % 97 AS VARCHAR(9)), '.5% (Smith and Jones, 1999, 2001).', chr(10),
  CASE WHEN page = 5 THEN concat('We use equa-', chr(10)) WHEN page = 7 THEN concat('as in fig-', chr(10)) ELSE '' END,
  CASE WHEN page = 39 THEN concat('References', chr(10), {NAMES}, ', A. (', CAST(1950 + doc_id % 70 AS VARCHAR(9)), '). A long title', chr(10), '  of a long-', chr(10), 'winded paper.', chr(10), ', and (1974). Again.', chr(10)) ELSE '' END,
  CASE WHEN page = 40 THEN concat('17', chr(10), 'Young, B. (2001). Another title.', chr(10), 'Appendix A', chr(10)) ELSE '' END,
  coalesce(text, '')) AS text
FROM ({PAGES}) p"""

#: Boxes on pages of 600 x 800, about sixty a page however many there are: (page, box, kind, x0, y0, x1, y1, label).
BOXES = """
SELECT CAST(floor(l_orderkey / 16) AS INT) AS page, l_orderkey * 10 + l_linenumber AS box,
  CASE l_linenumber % 3 WHEN 0 THEN 'caption' WHEN 1 THEN 'table' ELSE 'figure' END AS kind,
  CAST(l_partkey % 500 AS DOUBLE) AS x0, CAST(l_suppkey * 7 % 700 AS DOUBLE) AS y0,
  CAST(l_partkey % 500 + 20 + l_quantity * 2 AS DOUBLE) AS x1, CAST(l_suppkey * 7 % 700 + 10 + l_quantity AS DOUBLE) AS y1,
  concat('Part ', CAST(l_partkey % 20 AS VARCHAR(9))) AS label
FROM lineitem"""

#: Findings of six raters, one for each turn of every conversation: (paper_id, rater, id, severity, confidence, issue_type,
#: assessment, page, summary, claim); the summary is the turn's whole text.
FINDINGS = """
SELECT concat('paper-', CAST(CAST(floor(conv_id / 5) AS BIGINT) AS VARCHAR(20))) AS paper_id,
  CASE (conv_id * 31 + turn) % 6 WHEN 0 THEN 'numbers' WHEN 1 THEN 'claims' WHEN 2 THEN 'sources' WHEN 3 THEN 'prose' WHEN 4 THEN 'literature' ELSE 'theory' END AS rater, conv_id * 100 + turn AS id,
  CASE (conv_id + turn) % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity,
  CASE (conv_id + turn) % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'high' END AS confidence,
  CASE (conv_id * 7 + turn) % 6 WHEN 0 THEN 'manuscript_issue' WHEN 1 THEN 'reference_integrity' WHEN 2 THEN 'cannot_verify'
    WHEN 3 THEN 'bibliography_maintenance' WHEN 4 THEN 'parser_artifact' ELSE 'copyedit_issue' END AS issue_type,
  CASE (conv_id * 3 + turn) % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'partially' WHEN 3 THEN 'cannot_verify' ELSE 'no' END AS assessment,
  CASE WHEN (conv_id + turn) % 11 = 0 THEN NULL ELSE CAST(turn % 10 + 1 AS INT) END AS page, text AS summary, role AS claim
FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL"""

VIEWS = {"page_records": PAGES, "marked_pages": MARKED, "boxes": BOXES, "findings": FINDINGS}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Relations:
    """Tables and views of a folder by name; only what is asked for is read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """The select's rows, its tables read from the folder; no name is registered in the session."""
        used = {name: self.table(name) for name in TABLES if f" {name}" in text}
        text = text.replace("{", "{{").replace("}", "}}")
        for name in used:
            text = _named(text, name)
        return self.spark.sql(text, **used)

    def view(self, name: str) -> DataFrame:
        return self.sql(VIEWS[name])


def _named(text: str, name: str) -> str:
    return re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)


def oracle(body: str, *views: str) -> str:
    """DuckDB SQL: the body after the named views as common table expressions (a body may begin with more of them)."""
    head = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in views)
    if not head:
        return body
    body = body.strip().replace("WITH RECURSIVE ", "WITH ", 1)
    return f"WITH RECURSIVE {head}{', ' + body[4:] if body.startswith('WITH') else ' ' + body}"
