"""Editorial decisions and reports: rules as rows of violations, and the report that the decisions make."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import extract as X
from .checks import terminals
from .ranking import markdown_cell

# Dispositions, the generated appendix, identifiers, and the sections that a report needs.
KEPT = ("included", "narrowed", "appendix_only")
DISPOSITIONS = (*KEPT, "merged", "rejected")
TRACEABILITY = "Appendix: Traceability Map"
BLOCK_ID = r"^[a-z][a-z0-9_-]{0,79}$"
BOUNDARY = r"(?m)^ {0,3}#{1,2}(?:\s|$)|^\S[^\n]*\n {0,3}(?:=+|-+)[ \t]*(?:\n|$)"
CANONICAL = r"\bCANON-\d{3}\b"
SOURCE = r"\b[a-z][a-z0-9_]*:(?:[A-Z][A-Z0-9_-]*-\d{3}|claim_evidence_\d{3}|NA-\d{3})\b"
ANY_ID = r"\b(?:CANON-\d{3}|[A-Z]+-[A-Z]+-\d{3}|claim_evidence_\d{3}|NA-\d{3})\b"
PROCESS_NOTE = r"(?i)\b(?:done\.|wrote the final|report (?:is|was) saved|saved to|appears only under ignored status)\b"
REQUIRED = ("Executive Summary", "Suggested Revision Priorities", "Additional Findings")
SCOPE = ("Appendix: Review Scope and Limitations", "Review Configuration")
GRAMMAR, EXTERNAL = "Appendix: Grammar and Copyediting Issues", "Appendix: External Sources"
LEAST = 2000


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def pipe_cells(line: Column) -> Column:
    return F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"(?<!\\)\|")


def prose_errors(text: Column) -> Column:
    """Names of the rules that authored prose breaks: it sets no section or document boundary, and a table's header has a
    delimiter row of as many cells below it."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x))
    at = lambda i: F.coalesce(F.get(lines, i), F.lit(""))

    def headless(i: Column) -> Column:
        delimiters = pipe_cells(at(i + 1))
        sound = at(i + 1).startswith("|") & (F.size(pipe_cells(at(i))) == F.size(delimiters)) & F.forall(delimiters, lambda x: x.rlike(r"^\s*:?-{3,}:?\s*$"))
        return at(i).startswith("|") & ~((i > 0) & at(i - 1).startswith("|")) & ~sound

    heads = F.exists(F.sequence(F.lit(0), F.size(lines) - 1), headless)
    return F.array_compact(F.array(F.when(F.coalesce(text, F.lit("")).rlike(BOUNDARY), "boundary in prose"), F.when(heads, "table without delimiters")))


def _told(rows: DataFrame, subject: str, rules: dict[str, Column], more: Column | None = None) -> DataFrame:
    every = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    every = every if more is None else F.concat(every, more)
    return rows.select("paper_id", F.col(subject).alias("subject"), F.explode(every).alias("error"))


def material(severity: Column, issue_class: Column) -> Column:
    """Whether a finding is consequential: high or medium, and of the paper, its references or what can't be verified."""
    return F.coalesce(severity.isin("high", "medium") & issue_class.isin("manuscript_issue", "reference_integrity", "cannot_verify"), F.lit(False))


def identity_errors(artifacts: DataFrame, bundles: DataFrame) -> DataFrame:
    """(paper_id, subject, error) of editorial artifacts (paper_id of the run, version, told, the paper that the artifact names)
    whose version is not 1, or that name another paper than the bundle of findings (paper_id, bundle) does; subject is null, as
    it is the whole artifact."""
    wrong = ~F.col("version").eqNullSafe(F.lit(1)) | ~F.col("told").eqNullSafe(F.col("bundle"))
    rows = artifacts.join(bundles.select("paper_id", "bundle"), "paper_id", "left").where(wrong)
    return rows.select("paper_id", F.lit(None).cast("string").alias("subject"), F.lit("version or paper").alias("error"))


def decision_errors(findings: DataFrame, blocks: DataFrame, decisions: DataFrame, verdicts: DataFrame, assessor: str = "editor_model") -> DataFrame:
    """(paper_id, subject, error), each once, of editorial decisions that break a rule; subject is a block or a finding.

    findings are (paper_id, canonical_id, severity, issue_class); blocks (paper_id, place, id, section, markdown); decisions
    (paper_id, canonical_id, disposition, reason, block_ids, treatment, destination, surviving_claim, retained_evidence,
    qualifications); verdicts (paper_id, canonical_id, verdict, reason, assessor). Merge chains are followed to their end.
    """
    c, key = F.col, ["paper_id", "canonical_id"]
    known = findings.select(*key).distinct()
    times = blocks.groupBy("paper_id", "id").agg(F.count("*").alias("_n"))
    empty_ids = F.array().cast("array<string>")
    mine = F.coalesce("block_ids", empty_ids)
    substance = c("disposition").isin(*KEPT)
    treated = decisions.join(known, key, "left_semi").where(substance & (F.size(mine) == 1) & ~_blank(c("treatment")))
    treated = treated.select("paper_id", F.get(mine, F.lit(0)).alias("id")).distinct().withColumn("_treated", F.lit(True))
    some = blocks.join(times, ["paper_id", "id"], "left").join(treated, ["paper_id", "id"], "left")
    out = _told(
        some, "id",
        {
            "block id": ~c("id").rlike(BLOCK_ID) | (c("_n") > 1) | c("id").isNull(),
            "block section": _blank(c("section")) | (c("section") == TRACEABILITY) | c("section").rlike(r"[\r\n]") | F.ltrim("section").startswith("#"),
            "empty block": _blank(c("markdown")) & c("_treated").isNull(),
        },
        prose_errors(c("markdown")),
    )
    have = blocks.groupBy("paper_id").agg(F.collect_set("id").alias("_ids"), F.collect_set(F.when(c("section").startswith("Appendix:"), c("id"))).alias("_appendix"))
    count = decisions.groupBy(*key).agg(F.count("*").alias("_times"))
    rows = decisions.join(known.withColumn("_known", F.lit(True)), key, "left").join(count, key, "left").join(have, "paper_id", "left")
    goal = known.select("paper_id", c("canonical_id").alias("destination")).withColumn("_goal", F.lit(True))
    rows = rows.join(goal, ["paper_id", "destination"], "left").withColumn("_ids", F.coalesce("_ids", empty_ids)).withColumn("_appendix", F.coalesce("_appendix", empty_ids))
    merged, rejected = c("disposition") == "merged", c("disposition") == "rejected"
    out = out.unionByName(_told(
        rows, "canonical_id",
        {
            "unknown or duplicate": c("_known").isNull() | (c("_times") > 1),
            "unknown disposition": ~F.coalesce(c("disposition").isin(*DISPOSITIONS), F.lit(False)),
            "no reason": _blank(c("reason")),
            "block references": (F.size(F.array_distinct(mine)) != F.size(mine)) | (F.size(F.array_except(mine, "_ids")) > 0),
            "no rendered treatment": substance & ((F.size(mine) != 1) | _blank(c("treatment"))),
            "destination": substance & c("destination").isNotNull(),
            "no appendix": (c("disposition") == "appendix_only") & (F.size(F.array_except(mine, "_appendix")) > 0),
            "no surviving claim": (c("disposition") == "narrowed") & _blank(c("surviving_claim")),
            "rejected but treated": rejected & ((F.size(mine) > 0) | c("destination").isNotNull() | ~_blank(c("treatment"))),
            "merge destination": merged & ((F.size(mine) > 0) | c("_goal").isNull() | (c("destination") == c("canonical_id"))),
            "merge account": merged & (_blank(c("retained_evidence")) | _blank(c("qualifications"))),
        },
        prose_errors(c("treatment")),
    ))
    ends = merge_ends(decisions)
    out = out.unionByName(ends.where("error is not null").select("paper_id", c("canonical_id").alias("subject"), F.when(c("error") == "cycle", "cyclic merge").otherwise("no retained destination").alias("error")))
    checked = verdicts.groupBy(*key).agg(F.count("*").alias("_times"))
    judged = verdicts.join(checked, key, "left").join(known.withColumn("_known", F.lit(True)), key, "left")
    out = out.unionByName(_told(
        judged, "canonical_id",
        {
            "unknown or duplicate check": c("_known").isNull() | (c("_times") > 1), "assessor": _blank(c("reason")) | ~c("assessor").eqNullSafe(F.lit(assessor)),
            "not faithful": ~c("verdict").eqNullSafe(F.lit("faithful")),
        },
    ))
    lacking = lambda df, other, error: df.join(other.select(*key), key, "left_anti").select("paper_id", c("canonical_id").alias("subject"), F.lit(error).alias("error"))
    out = out.unionByName(lacking(known, decisions, "no decision"))
    out = out.unionByName(lacking(findings.where(material(c("severity"), c("issue_class"))), verdicts, "no check"))
    return out.distinct()


def merge_ends(decisions: DataFrame) -> DataFrame:
    """(paper_id, canonical_id, terminal, error) of merged decisions: where each one's chain ends, if that is kept."""
    c = F.col
    first = decisions.groupBy("paper_id", "canonical_id").agg(F.max_by("disposition", F.struct("disposition", "destination")).alias("d"), F.max(F.struct("disposition", "destination"))["destination"].alias("to"))
    name = lambda x: F.concat_ws("\n", "paper_id", x)
    rows = first.select(name("canonical_id").alias("id"), c("d").alias("disposition"), F.when(c("to").isNotNull(), name("to")).otherwise("").alias("destination"))
    ends = terminals(rows).withColumn("at", F.split("id", "\n"))
    last = lambda x: F.element_at(F.split(x, "\n"), -1)
    return ends.select(F.get("at", F.lit(0)).alias("paper_id"), F.get("at", F.lit(1)).alias("canonical_id"), last("terminal").alias("terminal"), "error")


def rendered_report(findings: DataFrame, blocks: DataFrame, decisions: DataFrame, title: str = "Report") -> DataFrame:
    """(paper_id, report): the title; blocks in order, a heading where the section changes, each with its prose and the
    treatments of the findings that are decided to stand there; then a row for each finding that tells its section (that of
    the end of its merge chain), summary, identifiers, disposition and reason. findings have a place, canonical_id,
    finding_summary and source_ids; decisions a place too. A report is a paper's, which bounds it."""
    c = F.col
    placed = decisions.select("paper_id", F.explode("block_ids").alias("id"), "place", F.trim("treatment").alias("treatment")).where("treatment <> ''")
    listed = lambda df, by, part: df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", part))), lambda x: x[part]).alias(part))
    treatments = listed(placed, ["paper_id", "id"], "treatment")
    order = Window.partitionBy("paper_id").orderBy("place")
    head = F.when(~c("section").eqNullSafe(F.lag("section").over(order)), F.concat(F.lit("## "), "section", F.lit("\n")))
    some = blocks.withColumn("_head", head).join(treatments, ["paper_id", "id"], "left")
    prose = F.when(F.trim("markdown") != "", F.concat(F.trim("markdown"), F.lit("\n")))
    parts = F.concat(F.array_compact(F.array("_head", prose)), F.transform(F.coalesce("treatment", F.array().cast("array<string>")), lambda t: F.concat(t, F.lit("\n"))))
    body = listed(some.withColumn("text", F.array_join(parts, "\n")).where("text <> ''"), ["paper_id"], "text")
    ends = merge_ends(decisions).where("error is null").select("paper_id", "canonical_id", "terminal")
    own = decisions.select("paper_id", "canonical_id", "disposition", "reason")
    goal = decisions.select("paper_id", c("canonical_id").alias("terminal"), F.get("block_ids", F.lit(0)).alias("id"))
    where = blocks.select("paper_id", "id", "section")
    rows = findings.join(own, ["paper_id", "canonical_id"]).join(ends, ["paper_id", "canonical_id"], "left").withColumn("terminal", F.coalesce("terminal", "canonical_id"))
    rows = rows.join(goal, ["paper_id", "terminal"], "left").join(where, ["paper_id", "id"], "left")
    shown = [F.coalesce("section", F.lit("Not included")), c("finding_summary"), c("canonical_id"), F.array_join("source_ids", "; "), F.concat("disposition", F.lit(": "), "reason")]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(markdown_cell, shown)), F.lit(" |"))
    table = listed(rows.withColumn("line", line), ["paper_id"], "line")
    header = f"## {TRACEABILITY}\n\n| Report section | Finding | Canonical ID | Source finding IDs | Disposition and evidence-based reason |\n| --- | --- | --- | --- | --- |"
    whole = F.concat(F.array(F.lit(f"# {title}\n")), F.coalesce("text", F.array().cast("array<string>")), F.array(F.lit(header)), F.coalesce("line", F.array().cast("array<string>")))
    return body.join(table, "paper_id", "full_outer").select("paper_id", F.concat(F.rtrim(F.array_join(whole, "\n")), F.lit("\n")).alias("report"))


def _section(report: Column, heading: str) -> Column:
    """A section with its heading, up to the next; an empty text without it."""
    return F.coalesce(F.regexp_extract(F.concat(report, F.lit("\n## ")), rf"(?s)(## {heading}.*?)(?=\n## )", 1), F.lit(""))


def report_failures(reports: DataFrame, findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """(report_id, failure), each once, of reports (report_id, report) against their findings (report_id, canonical_id,
    issue_class, source_ids) and evidence (report_id, url). A report without findings needs neither length nor identifiers."""
    c = F.col
    of = findings.groupBy("report_id").agg(F.collect_set("canonical_id").alias("_ids"), F.flatten(F.collect_set("source_ids")).alias("_sources"), F.bool_or(c("issue_class") == "copyedit_issue").alias("_copyedit"))
    seen = evidence.groupBy("report_id").agg(F.collect_set(F.trim("url")).alias("_urls"))
    none = F.array().cast("array<string>")
    rows = reports.join(of, "report_id", "left").join(seen, "report_id", "left")
    rows = rows.withColumns({k: F.coalesce(k, none) for k in ("_ids", "_sources", "_urls")}).withColumn("_map", _section(c("report"), TRACEABILITY)).withColumn("_external", _section(c("report"), EXTERNAL))
    text, some = c("report"), F.size("_ids") > 0
    has = lambda heading: F.contains(text, F.lit(f"## {heading}"))
    full = lambda heading: F.exists(F.slice(F.split(_section(text, heading), "\n"), 2, 1_000_000), lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s*#{1,6}(?:\s|$)"))
    # The map's section is taken out of the text before the body is searched.
    body = F.replace(text, F.when(c("_map") != "", c("_map")).otherwise("\x00"), F.lit(""))
    cited = X.urls(text)
    rules = {
        "too short": some & (F.length(F.trim(text)) < LEAST),
        "process note": text.rlike(PROCESS_NOTE),
        "no scope": ~(has(SCOPE[0]) | has(SCOPE[1])),
        "no identifiers": some & ~text.rlike(ANY_ID),
        f"no {TRACEABILITY}": c("_map") == "",
        "identifiers in body": (c("_map") != "") & (body.rlike(CANONICAL) | body.rlike(SOURCE)),
        f"no {GRAMMAR}": F.coalesce("_copyedit", F.lit(False)) & ~has(GRAMMAR),
    }
    rules |= {f"no {h}": ~has(h) for h in REQUIRED}
    rules |= {f"empty {h}": has(h) & ~full(h) for h in (*REQUIRED, *SCOPE, TRACEABILITY)}
    main = F.array_intersect(X.urls(F.replace(text, F.when(c("_external") != "", c("_external")).otherwise("\x00"), F.lit(""))), "_urls")
    lists = {
        "unknown identifier": F.array_except(F.array_distinct(F.regexp_extract_all("_map", F.lit(f"({CANONICAL})"), 1)), "_ids"),
        "unknown source": F.array_except(F.array_distinct(F.regexp_extract_all("_map", F.lit(f"({SOURCE})"), 1)), "_sources"),
        "address not in evidence": F.array_except(cited, "_urls"),
        "address not in appendix": F.array_except(main, X.urls(c("_external"))),
    }
    own = F.array_compact(F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(name)) for name, r in rules.items()]))
    prefixed = lambda name: lambda x: F.concat(F.lit(f"{name}: "), x)
    named = [F.transform(some_, prefixed(name)) for name, some_ in lists.items()]
    out = rows.select("report_id", F.explode(F.concat(own, *named)).alias("failure"))
    return out.unionByName(_map_failures(rows.where("_map <> ''").select("report_id", "_map"), findings)).distinct()


def map_rows(section: Column) -> Column:
    """Rows (ids, sources) of a traceability section's table: identifiers in the columns that its header names."""
    lines = F.transform(F.split(section, "\n"), lambda x: F.trim(x))
    cells = lambda x: F.transform(pipe_cells(x), lambda y: F.trim(y))
    header = lambda x: x.startswith("|") & F.array_contains(cells(x), "Canonical ID") & F.array_contains(cells(x), "Source finding IDs")
    at = F.array_position(F.transform(lines, header), True).cast("int")
    head = cells(F.get(lines, at - 1))
    after = F.slice(lines, at + 1, F.size(lines))
    stop = F.array_position(F.transform(after, lambda x: (x != "") & ~x.startswith("|")), True).cast("int")
    table = F.filter(F.when(stop > 0, F.slice(after, 1, stop - 1)).otherwise(after), lambda x: x.startswith("|") & ~F.forall(cells(x), lambda y: y.rlike("^:?-{3,}:?$")))
    column = lambda x, name: F.coalesce(F.get(cells(x), (F.array_position(head, name) - 1).cast("int")), F.lit(""))
    found = lambda x, name, p: F.regexp_extract_all(column(x, name), F.lit(f"({p})"), 1)
    rows = F.transform(table, lambda x: F.struct(found(x, "Canonical ID", CANONICAL).alias("ids"), found(x, "Source finding IDs", SOURCE).alias("sources")))
    return F.when(at > 0, rows).otherwise(F.from_json(F.lit("[]"), "array<struct<ids:array<string>,sources:array<string>>>"))


def _map_failures(sections: DataFrame, findings: DataFrame) -> DataFrame:
    c, key = F.col, ["report_id", "canonical_id"]
    rows = sections.select("report_id", F.explode(map_rows(c("_map"))).alias("r")).select("report_id", "r.ids", "r.sources")
    odd = rows.where(F.size("ids") != 1).select("report_id", F.lit("row without one identifier").alias("failure"))
    each = rows.select("report_id", F.explode(F.array_distinct("ids")).alias("canonical_id"), "sources")
    times = each.groupBy(*key).agg(F.count("*").alias("_n"), F.first("sources").alias("_told"))
    want = findings.join(sections.select("report_id"), "report_id", "left_semi").select(*key, "source_ids").join(times, key, "left")
    n = F.coalesce("_n", F.lit(0))
    label = lambda name: F.concat(F.lit(f"{name}: "), "canonical_id")
    both = lambda name, x: F.concat(F.lit(f"{name}: "), "canonical_id", F.lit(" "), x)
    lacking = F.when(n == 1, F.transform(F.array_except("source_ids", "_told"), lambda x: both("source not in row", x)))
    wrong = F.when(n == 1, F.transform(F.array_except("_told", "source_ids"), lambda x: both("source of another row", x)))
    none = F.array().cast("array<string>")
    own = F.array_compact(F.array(F.when(n == 0, label("not in the table")), F.when(n > 1, label("several rows"))))
    return odd.union(want.select("report_id", F.explode(F.concat(own, F.coalesce(lacking, none), F.coalesce(wrong, none))).alias("failure")))
