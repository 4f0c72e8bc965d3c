"""Scores, routes and numbers of canonical findings, and the tables of an editor's brief."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Points, order of classes, sections, areas by rater and the two limits.
SEVERITY_POINTS = {"high": 60, "medium": 35, "low": 10}
CONFIDENCE_POINTS = {"high": 15, "medium": 8, "low": 0}
CLASS_POINTS = {"manuscript_issue": 15, "reference_integrity": 4, "bibliography_maintenance": -12, "copyedit_issue": -45}
CLASS_POINTS_BY_SEVERITY = {"parser_artifact": (10, -18), "cannot_verify": (12, -5)}
CLASS_ORDER = ("manuscript_issue", "reference_integrity", "cannot_verify", "bibliography_maintenance", "parser_artifact", "copyedit_issue")
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3}
CONFIDENCE_RANK = {"low": 1, "medium": 2, "high": 3}
ASSESSMENT_RANK = {"yes": 1, "cannot_verify": 2, "partially": 3, "no": 4}
TOP_SCORE, TOP_COUNT = 55, 8
AREAS = {
    "crossref_auditor": "Cross-reference", "source_consistency_auditor": "Source consistency", "numerical_auditor": "Numerical", "claim_evidence_auditor": "Claim/evidence",
    "identification_auditor": "Identification", "robustness_auditor": "Robustness", "sample_construction_auditor": "Sample construction",
    "abstract_conclusion_consistency_auditor": "Abstract/conclusion consistency", "limitations_external_validity_auditor": "External validity", "model_equation_auditor": "Model/equation",
    "theory_logic_auditor": "Theory logic", "literature_auditor": "Literature", "data_availability_replication_auditor": "Replication", "institutional_context_auditor": "Institutional context",
    "power_multiple_testing_auditor": "Power/multiple testing", "design_randomization_auditor": "Experimental design", "economic_magnitude_auditor": "Economic magnitude",
}
CLASS_AREAS = {
    "reference_integrity": "Reference integrity", "bibliography_maintenance": "Bibliography maintenance", "parser_artifact": "Parser/preprocessing", "cannot_verify": "Cannot verify",
    "copyedit_issue": "Grammar/copyediting",
}


def look_up(c: Column, values: dict, default=None) -> Column:
    out = F.lit(default)
    for key, value in values.items():
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


def priority(severity: Column, confidence: Column, issue_class: Column) -> Column:
    """Points of severity, confidence and class; how many raters agree adds nothing."""
    points = look_up(severity, SEVERITY_POINTS, 0) + look_up(confidence, CONFIDENCE_POINTS, 0) + look_up(issue_class, CLASS_POINTS, 0)
    for name, (high, other) in CLASS_POINTS_BY_SEVERITY.items():
        points = points + F.when(issue_class == name, F.when(severity == "high", high).otherwise(other)).otherwise(0)
    return points


def route(issue_class: Column, assessment: Column, confidence: Column, score: Column, literature: Column) -> Column:
    """The report's section of a finding, by the first rule that holds."""
    unverified = F.coalesce((issue_class == "cannot_verify") | (assessment == "cannot_verify"), F.lit(False))
    return (
        F.when(issue_class == "copyedit_issue", "grammar_appendix")
        .when(issue_class == "parser_artifact", "parser_appendix")
        .when(unverified, "cannot_verify")
        .when(issue_class == "reference_integrity", "reference_integrity")
        .when(issue_class == "bibliography_maintenance", "bibliography_appendix")
        .when(literature, "literature")
        .when((issue_class == "manuscript_issue") & (confidence == "high") & (score >= TOP_SCORE), "highest_priority")
        .otherwise("additional")
    )


def cap_top(routed: DataFrame, paper: str, key: str, count: int = TOP_COUNT) -> DataFrame:
    """Of each paper's highest_priority findings the `count` best by score, then key, stay; others go to additional.
    The window's limit is pushed before the shuffle, so a paper of many findings sends few."""
    top = routed.where("section = 'highest_priority'").select(paper, key, "score")
    best = Window.partitionBy(paper).orderBy(F.desc("score"), key)
    kept = top.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= count).select(paper, key, F.lit(True).alias("_kept"))
    out = routed.join(kept, [paper, key], "left")
    late = (F.col("section") == "highest_priority") & F.col("_kept").isNull()
    return out.withColumn("section", F.when(late, "additional").otherwise(F.col("section"))).drop("_kept")


def number(findings: DataFrame, paper: str, key: str) -> DataFrame:
    """findings with canonical_id: CANON- and a number of three digits or more, by class, falling severity, key."""
    rank = look_up(F.col("issue_class"), {c: i for i, c in enumerate(CLASS_ORDER)}, len(CLASS_ORDER))
    order = Window.partitionBy(paper).orderBy(rank, F.desc(look_up(F.col("severity"), SEVERITY_RANK, 0)), key)
    return findings.withColumn("canonical_id", F.format_string("CANON-%03d", F.row_number().over(order)))


def merge_group(findings: DataFrame, keys: list[str]) -> DataFrame:
    """What a group of findings comes to: stronger severity and assessment, weaker confidence, sorted raters, their number."""
    best = lambda c, ranks, pick: pick(F.struct(look_up(F.col(c), ranks, ranks.get("medium", 0)).alias("r"), F.col(c).alias("v")))["v"]
    return findings.groupBy(*keys).agg(
        best("severity", SEVERITY_RANK, F.max).alias("severity"),
        best("assessment", ASSESSMENT_RANK, F.max).alias("assessment"),
        best("confidence", CONFIDENCE_RANK, F.min).alias("confidence"),
        F.array_join(F.array_sort(F.collect_set("rater")), ",").alias("raters"),
        F.count("*").alias("n_findings"),
    )


def merged_findings(findings: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys and the lists of each group, its findings (rater, id, category, finding_summary, claim_text, page, quote,
    evidence_summary, cannot_verify_reason, suggested_fix) in the order: of the first one summary, claim, page and quote;
    sources; different raters, categories, pages and quotes as they first come; and, with rater and id, the evidence,
    reasons and fixes that are told. A group is what raters say of one matter, which bounds it."""
    parts = ("rater", "id", "category", "finding_summary", "claim_text", "page", "quote", "evidence_summary", "cannot_verify_reason", "suggested_fix")
    rows = F.array_sort(F.collect_list(F.struct(*order, F.struct(*parts).alias("f"))))
    one = findings.groupBy(*keys).agg(F.transform(rows, lambda x: x["f"]).alias("f"))
    first = lambda part: F.get("f", F.lit(0))[part]
    different = lambda part: F.array_distinct(F.array_compact(F.transform("f", lambda x: x[part])))
    told = lambda part: F.transform(F.filter("f", lambda x: x[part] != ""), lambda x: F.struct(x["rater"].alias("rater"), x["id"].alias("id"), x[part].alias("text")))
    return one.select(
        *keys, *[first(p).alias(p) for p in ("finding_summary", "claim_text", "page", "quote")],
        F.transform("f", lambda x: F.struct(x["rater"].alias("rater"), x["id"].alias("id"))).alias("sources"),
        different("rater").alias("raters"), different("category").alias("categories"), different("page").alias("pages"), different("quote").alias("quotes"),
        told("evidence_summary").alias("evidence"), told("cannot_verify_reason").alias("reasons"), told("suggested_fix").alias("fixes"),
    )


def canonical_findings(findings: DataFrame, keys: list[str]) -> DataFrame:
    """The whole record of each group of findings, whatever order they come in.

    findings: rater, id, issue_class, category, issue_type, finding_summary, claim_text, evidence_summary, severity,
    assessment, confidence, cannot_verify_reason, suggested_fix, numeric_check (text), location (struct with page and
    text_quote), source_objects and links (arrays of structs), and keys. Findings go by page (those without one last), rater
    and id. Of the first are summary, claim, primary place and quote; severity and assessment are the strongest, confidence
    the weakest; raters, categories, places and quotes are told once, in the order in which they first come; evidence, reasons,
    fixes, source objects, links and numeric checks carry rater and id. assessment_counts says how often each assessment is
    given, consensus is agreed if there is one at most. A group is what raters say of one matter, which bounds it."""
    c = F.col
    parts = (
        "rater", "id", "category", "issue_type", "finding_summary", "claim_text", "evidence_summary", "severity", "assessment", "confidence",
        "cannot_verify_reason", "suggested_fix", "numeric_check", "location", "source_objects", "links",
    )
    order = F.struct(c("location.page").isNull().alias("none"), c("location.page").alias("page"), "rater", c("id").cast("string").alias("id"))
    told_order = F.xxhash64(*(p for p in parts if p not in ("location", "source_objects", "links")))
    rows = findings.withColumn("_o", order).withColumn("_h", told_order)
    best = lambda x, ranks, default, pick: pick(F.struct(look_up(F.coalesce(x, F.lit(default)), ranks, ranks.get(default, 0)).alias("r"), F.coalesce(x, F.lit(default)).alias("v")))["v"]
    one = rows.groupBy(*keys, "issue_class").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_o", "_h", F.struct(*parts).alias("f")))), lambda x: x["f"]).alias("f"),
        best("severity", SEVERITY_RANK, "low", F.max).alias("severity"), best("assessment", ASSESSMENT_RANK, "yes", F.max).alias("assessment"),
        best("confidence", CONFIDENCE_RANK, "medium", F.min).alias("confidence"),
    )
    first = lambda part: F.get("f", F.lit(0))[part]
    who = lambda x: (x["rater"].alias("rater"), x["id"].alias("id"))
    different = lambda part: F.array_distinct(F.array_compact(F.transform("f", part)))
    told = lambda part: F.transform(F.filter("f", lambda x: x[part] != ""), lambda x: F.struct(*who(x), x[part].alias("text")))
    each = lambda part, name: F.flatten(F.transform(F.filter("f", lambda x: x[part].isNotNull()), lambda x: F.transform(x[part], lambda y: F.struct(*who(x), y.alias(name)))))
    given = F.filter(F.transform("f", lambda x: x["assessment"]), lambda a: a.isNotNull())
    counts = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(given)), lambda a: F.struct(a, F.size(F.filter(given, lambda b: b == a)))))
    somewhere = lambda x: F.when(F.to_json(x["location"]) != "{}", x["location"])
    out = one.select(
        *keys, "issue_class", "severity", "assessment", "confidence", different(lambda x: x["rater"]).alias("raters"),
        F.transform("f", lambda x: F.struct(*who(x))).alias("sources"), c("f").alias("details"), different(lambda x: x["category"]).alias("categories"),
        first("finding_summary").alias("finding_summary"), F.coalesce(first("claim_text"), F.lit("")).alias("claim_text"),
        first("location").alias("primary_location"), first("location")["text_quote"].alias("primary_quote"), different(somewhere).alias("locations"),
        different(lambda x: F.when(x["location"]["text_quote"] != "", x["location"]["text_quote"])).alias("quotes"), told("evidence_summary").alias("evidence"),
        told("cannot_verify_reason").alias("reasons"), told("suggested_fix").alias("fixes"), told("numeric_check").alias("numeric_checks"),
        each("source_objects", "source_object").alias("source_objects"), each("links", "link").alias("links"),
        F.transform("f", lambda x: F.struct(*who(x), x["assessment"].alias("assessment"))).alias("assessments"), counts.alias("assessment_counts"),
    )
    return out.withColumn("consensus", F.when(F.size("assessment_counts") <= 1, "agreed").otherwise("mixed"))


def area(issue_class: Column, raters: Column) -> Column:
    """Where a finding belongs: for issues of the paper by the first of the listed raters, else by class."""
    by_rater = F.coalesce(*[F.when(F.array_contains(raters, name), F.lit(where)) for name, where in AREAS.items()], F.lit("Manuscript"))
    return F.when(issue_class == "manuscript_issue", by_rater).otherwise(F.coalesce(look_up(issue_class, CLASS_AREAS), F.lit("Other")))


def brief(findings: DataFrame, sections: dict[str, str]) -> DataFrame:
    """(paper_id, brief): an editor's brief of canonical findings (paper_id, canonical_id, severity, confidence, issue_class,
    score, section, area, location, problem, source_ids): how many there are by class, severity and confidence; the ranked
    candidates, the additional ones, what the body must cover, where each goes, and the rows of the map. `sections` names
    each route's section. The texts of a paper's findings meet in one row, which a paper bounds."""
    c = F.col
    short = F.when(F.length("problem") > 120, F.concat(F.rtrim(F.substring("problem", 1, 117)), F.lit("..."))).otherwise(c("problem"))
    rows = findings.withColumn("issue", short).withColumn("to", look_up(c("section"), sections, "Additional Findings"))
    line = lambda *columns: F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(c(x)) for x in columns]), F.lit(" |"))
    covered = c("severity").isin("high", "medium") & c("issue_class").isin("manuscript_issue", "cannot_verify", "reference_integrity")
    tables = {
        "Machine-Ranked Candidate Findings": (("canonical_id", "severity", "confidence", "issue"), ("Canonical ID", "Severity", "Confidence", "Issue"), c("section") == "highest_priority", -c("score")),
        "Additional Findings Candidates": (("area", "canonical_id", "location", "issue"), ("Area", "Canonical ID", "Location", "Issue"), c("section") == "additional", F.lit(0)),
        "Required Body Coverage Audit": (("canonical_id", "issue_class", "severity", "location", "issue"), ("Canonical ID", "Class", "Severity", "Location", "Issue"), covered, F.lit(0)),
        "Section Routing Guidance": (("canonical_id", "to", "location"), ("Canonical ID", "Recommended section", "Location"), F.lit(True), F.lit(0)),
        "Traceability Map Rows": (("to", "issue", "canonical_id", "source_ids"), ("Report section", "Finding", "Canonical ID", "Source finding IDs"), F.lit(True), F.lit(0)),
    }
    listed = {}
    for k, (columns, _, which, first) in enumerate(tables.values()):
        found = F.collect_list(F.when(F.coalesce(which, F.lit(False)), F.struct(first.alias("first"), c("canonical_id").alias("key"), line(*columns).alias("line"))))
        listed[f"t{k}"] = F.transform(F.array_sort(found), lambda x: x["line"])
    counts = {n: F.count_if(c(n[0]) == n[1]) for n in [(col, v) for col in ("severity", "confidence") for v in ("high", "medium", "low")]}
    of_class = {k: F.count_if(c("issue_class") == k) for k in CLASS_ORDER}
    one = rows.groupBy("paper_id").agg(
        F.count("*").alias("n"), *[x.alias("_".join(n)) for n, x in counts.items()], *[x.alias(f"class_{k}") for k, x in of_class.items()], *[x.alias(n) for n, x in listed.items()]
    )
    told = lambda names, prefix: F.concat_ws(", ", *[F.concat(F.lit(f"{n} "), c(f"{prefix}_{n}").cast("string")) for n in names])
    summary = F.concat(
        F.lit("## Run Summary\n\n- findings: "), c("n").cast("string"), F.lit("\n- classes: "), told(CLASS_ORDER, "class"),
        F.lit("\n- severities: "), told(("high", "medium", "low"), "severity"), F.lit("\n- confidences: "), told(("high", "medium", "low"), "confidence"),
    )
    parts = [F.lit("# Editor Brief"), summary]
    for k, (heading, (_, heads, _, _)) in enumerate(tables.items()):
        top = f"| {' | '.join(heads)} |\n| {' | '.join('---' for _ in heads)} |\n"
        table = F.when(F.size(f"t{k}") > 0, F.concat(F.lit(top), F.array_join(f"t{k}", "\n"))).otherwise("_None._")
        parts += [F.lit(f"## {heading}"), table]
    return one.select("paper_id", F.concat(F.concat_ws("\n\n", *parts), F.lit("\n")).alias("brief"))


def provenance(outputs: DataFrame) -> DataFrame:
    """(paper_id, provenance): a Markdown table of raters' outputs (paper_id, place, rater, path, run_status, findings), in the
    order of their places."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(F.col(c)) for c in ("rater", "path", "run_status", "findings")]), F.lit(" |"))
    rows = outputs.withColumn("run_status", F.coalesce("run_status", F.lit("unknown"))).withColumn("line", line)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"])
    head = "| Rater | Validated JSON path | Status | Findings |\n| --- | --- | --- | --- |\n"
    return rows.groupBy("paper_id").agg(F.concat(F.lit(head), F.array_join(listed, "\n")).alias("provenance"))


def input_documents(parts: DataFrame) -> DataFrame:
    """(paper_id, document): what an editor is given: prompt, where bundle and outputs lie, the brief, the bundle (as JSON, or
    the plan that says how to read it) and the outputs' provenance, of parts (paper_id, prompt, bundle_path, outputs_path,
    brief, bundle, plan, provenance)."""
    c = F.col
    bundle = F.coalesce("plan", F.concat(F.lit("```json\n"), "bundle", F.lit("\n```\n")))
    text = F.concat(
        c("prompt"), F.lit("\n\n# Editor Input Metadata\n\n- paper_id: `"), c("paper_id"), F.lit("`\n- normalized_bundle: `"), c("bundle_path"), F.lit("`\n- outputs: `"), c("outputs_path"),
        F.lit("`\n\n\n"), c("brief"), F.lit("\n\n# Normalized Editor Bundle\n\n"), bundle, F.lit("\n\n# Validated Output Provenance\n\n"), F.coalesce("provenance", F.lit("_None._")), F.lit("\n"),
    )
    return parts.select("paper_id", text.alias("document"))


def bounded_input(documents: DataFrame, most_bytes: int = 1_000_000) -> DataFrame:
    """(paper_id, serialization, document): the first of a paper's forms pretty, minified and file_backed that is within the
    bound; null and `too large` where none is, as nothing is cut."""
    forms = ("pretty", "minified", "file_backed")
    fits = [F.when(F.octet_length(f) <= most_bytes, F.struct(F.lit(f.replace("_", "-")).alias("s"), F.col(f).alias("d"))) for f in forms]
    first = F.coalesce(*fits)
    return documents.select("paper_id", F.coalesce(first["s"], F.lit("too large")).alias("serialization"), first["d"].alias("document"))


def markdown_cell(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\s+", " "))


def markdown_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with `line`, a table row in Markdown."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(F.col(c)) for c in columns]), F.lit(" |"))
    return rows.withColumn("line", cells)
