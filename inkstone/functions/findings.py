"""Columns of findings: texts, places, sources, labels, and what counts as unverifiable. All built in."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


def _told(c: Column) -> Column:
    """The text, null where it is empty (blanks are told)."""
    return F.when(c != "", c)


def problem_text(finding_summary: Column, evidence_summary: Column, claim_text: Column) -> Column:
    """The first of the three that is told, on one line; an empty text without one."""
    return T.squash(F.coalesce(_told(finding_summary), _told(evidence_summary), _told(claim_text), F.lit("")))


def confidence(c: Column) -> Column:
    return F.coalesce(_told(c), F.lit("medium"))


def page_of(page: Column) -> Column:
    """The page of a location that is a whole number; null otherwise."""
    return F.when(page.rlike("^-?[0-9]+$"), page.try_cast("int"))


def location_text(page: Column, page_label: Column, section: Column) -> Column:
    """page, label and section of a location as far as they are told."""
    parts = F.array_compact(F.array(F.concat(F.lit("page "), page.cast("string")), F.concat(F.lit("label "), _told(page_label)), _told(section)))
    return F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("location not specified")


def source_ids(sources: Column) -> Column:
    """rater:id of the sources (structs of both) that tell both, by semicolons."""
    told = F.filter(sources, lambda s: (s["rater"] != "") & (s["id"] != ""))
    return F.array_join(F.transform(told, lambda s: F.concat_ws(":", s["rater"], s["id"])), "; ")


def rater_names(raters: Column, sources: Column) -> Column:
    """Different raters of a finding and of its sources, sorted."""
    own = F.transform(F.filter(sources, lambda s: s["rater"] != ""), lambda s: s["rater"])
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(raters, F.array().cast("array<string>")), own)))


def label(finding_id: Column, finding_summary: Column, claim_text: Column) -> Column:
    """The id with the summary or else the claim, on one line."""
    name = F.coalesce(finding_id, F.lit("unknown-id"))
    said = lambda c: T.squash(F.coalesce(c, F.lit("")))
    text = F.when(said(finding_summary) != "", said(finding_summary)).otherwise(said(claim_text))
    return F.when(text != "", F.concat(name, F.lit(": "), text)).otherwise(name)


def selection_reasons(selected: Column) -> Column:
    """Map from the name of each selected (structs of name and reason) to its reason, with a stated default."""
    named = F.filter(selected, lambda s: s["name"] != "")
    pairs = F.transform(named, lambda s: F.struct(s["name"], F.coalesce(_told(s["reason"]), F.lit("selected by rater applicability routing"))))
    return F.map_from_entries(pairs)


def unverifiable_in_contract(assessment: Column, issue_type: Column, category: Column) -> Column:
    """Whether a finding counts as unverifiable where output is validated: by assessment, type, or its category's words."""
    said = T.squash(F.lower(F.coalesce(category, F.lit("")))).contains("cannot_verify")
    return F.coalesce(assessment == "cannot_verify", F.lit(False)) | F.coalesce(issue_type == "cannot_verify", F.lit(False)) | said


def unverifiable_in_brief(issue_class: Column, assessment: Column, reasons: Column) -> Column:
    """Whether a merged finding counts as unverifiable where it is routed: by class, assessment, or any reason given."""
    some = F.coalesce(F.size(reasons) > 0, F.lit(False))
    return F.coalesce(issue_class == "cannot_verify", F.lit(False)) | F.coalesce(assessment == "cannot_verify", F.lit(False)) | some
