"""Coverage ledgers: what each rater must cover, and how a ledger breaks its rules, as rows of violations."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Raters who cover every display, raters who cover every cited equation, the rater who must name claims.
DISPLAY_RATERS = ("source_consistency_auditor", "numerical_auditor", "parser_quality_auditor")
EQUATION_RATERS = ("model_equation_auditor", "theory_logic_auditor")
CLAIM_RATER = "claim_evidence_auditor"
REMIT = "assigned_remit"
KEYS = ["paper_id", "rater", "item_id"]


def assigned(roster: DataFrame, objects: DataFrame, crossrefs: DataFrame) -> DataFrame:
    """(paper_id, rater, item_id, object_ids) of all that the raters (paper_id, rater) must cover: the remit; each retained
    display of objects (paper_id, id, kind, path, page) for some; for others each equation that crossrefs (paper_id, page,
    kind, label) cite, with the page's objects."""
    c = F.col
    none = F.array().cast("array<string>")
    remit = roster.select("paper_id", "rater", F.lit(REMIT).alias("item_id"), none.alias("object_ids"))
    shown = (c("kind") == "text_span") & c("path").rlike(r"^(?:tables/.*\.md|figures/.*\.txt)$")
    displays = objects.where(shown).select("paper_id", F.concat(F.lit("display:"), "id").alias("item_id"), F.array("id").alias("object_ids"))
    on_page = objects.where(c("path").startswith("pages/")).groupBy("paper_id", "page").agg(F.array_sort(F.collect_set("id")).alias("object_ids"))
    cited = crossrefs.where(T.crossref_kind(c("kind")) == "equation").select("paper_id", "page", F.coalesce("label", F.lit("equation")).alias("label")).distinct()
    equations = cited.join(on_page, ["paper_id", "page"], "left").select(
        "paper_id", F.concat_ws(":", F.lit("equation"), c("page").cast("string"), "label").alias("item_id"), F.coalesce("object_ids", none).alias("object_ids")
    )
    some = lambda names, items: roster.where(c("rater").isin(*names)).join(items, "paper_id").select(*KEYS, "object_ids")
    return remit.unionByName(some(DISPLAY_RATERS, displays)).unionByName(some(EQUATION_RATERS, equations))


def coverage_errors(records: DataFrame, required: DataFrame, objects: DataFrame, findings: DataFrame, completion: DataFrame) -> DataFrame:
    """(paper_id, rater, item_id, error), each once, of ledgers that break a rule; item_id is null where a whole ledger does.

    records are (paper_id, rater, item_id, status, claim, source_object_ids, reason, attempted, check_performed, importance,
    finding_ids, scope); required as assigned() gives it; objects (paper_id, id); findings (paper_id, rater, id); completion
    (paper_id, rater, state). Sets are compared by anti joins on single ids, rules on a record's own columns in one pass.
    """
    c = F.col
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    is_claim = F.coalesce(c("item_id").startswith("claim:"), F.lit(False))
    known = required.select(*KEYS, c("object_ids").alias("_need")).withColumn("_required", F.lit(True))
    rows = records.join(known, KEYS, "left").join(completion.select("paper_id", "rater", "state"), ["paper_id", "rater"], "left")
    complete = F.coalesce(c("state").isin("complete", "not_applicable"), F.lit(False))
    ids, found = F.coalesce("source_object_ids", F.array().cast("array<string>")), F.coalesce("finding_ids", F.array().cast("array<string>"))
    stated = ~blank(c("claim")) | (c("status").eqNullSafe(F.lit("not_applicable")) & c("claim").isNull())
    is_required = F.coalesce("_required", F.lit(False))
    status = lambda *names: F.coalesce(c("status").isin(*names), F.lit(False))
    rules: dict[str, Column] = {
        "unknown item": ~is_required & ~(is_claim & stated),
        "assigned objects omitted": is_required & (F.size(F.array_except("_need", ids)) > 0),
        "claim without evidence": is_claim & (F.size(ids) == 0),
        "exclusion without reason": status("cannot_verify", "not_applicable", "not_checked") & blank(c("reason")),
        "not attempted": ~status("not_checked") & (~c("attempted").eqNullSafe(F.lit(True)) | blank(c("check_performed"))),
        "contradicts completion": complete & (is_required | c("importance").eqNullSafe(F.lit("central"))) & status("not_checked"),
        "finding link": status("linked_finding") != (F.size(found) > 0),
        "sample without reason": c("scope").eqNullSafe(F.lit("sampled")) & blank(c("reason")),
    }
    told = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda e: e.isNotNull())
    own = rows.select(*KEYS, F.explode(told).alias("error"))
    named = lambda df, error: df.select(*KEYS).withColumn("error", F.lit(error))
    sources = records.select(*KEYS, F.explode("source_object_ids").alias("id")).join(objects.select("paper_id", "id"), ["paper_id", "id"], "left_anti")
    linked = records.select(*KEYS, F.explode("finding_ids").alias("id")).join(findings.select("paper_id", "rater", "id"), ["paper_id", "rater", "id"], "left_anti")
    twice = records.groupBy(*KEYS).agg(F.count("*").alias("n")).where("n > 1")
    whole = lambda df, error: df.select("paper_id", "rater", F.lit(None).cast("string").alias("item_id"), F.lit(error).alias("error"))
    with_any = records.select("paper_id", "rater").distinct()
    empty = completion.join(with_any, ["paper_id", "rater"], "left_anti")
    central = records.where(is_claim & ~blank(c("claim")) & c("importance").eqNullSafe(F.lit("central")) & ~status("not_applicable")).select("paper_id", "rater").distinct()
    owes = completion.where((c("rater") == CLAIM_RATER) & (c("state") == "complete")).join(with_any, ["paper_id", "rater"], "left_semi")
    out = own.unionByName(named(sources, "unknown object")).unionByName(named(linked, "unknown finding")).unionByName(named(twice, "duplicate item"))
    out = out.unionByName(named(required.join(records, KEYS, "left_anti").join(with_any, ["paper_id", "rater"], "left_semi"), "unaddressed"))
    out = out.unionByName(whole(empty, "no ledger")).unionByName(whole(owes.join(central, ["paper_id", "rater"], "left_anti"), "no central claim"))
    return out.distinct()
