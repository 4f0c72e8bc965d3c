"""Predicates and classes of pages and findings; all built in."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

CAPTION_START = r"(?i)^\s*(?:table|figure|fig\.)\s+(?:[A-Z]\.?)?\d+(?:\.\d+)?[A-Za-z]?(?:\s*:|\s*$)"
ISSUE_CLASSES = ("manuscript_issue", "reference_integrity", "cannot_verify", "bibliography_maintenance", "parser_artifact", "copyedit_issue")


def sparse_page(text: Column) -> Column:
    """Whether little text is what such a page should have: empty, a caption, a few short lines, a key word, per cents."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    whole = T.squash(text)
    short = F.length(whole) < 250
    percents = F.length(whole) - F.length(F.replace(whole, F.lit("%"), F.lit("")))
    return (
        (F.size(lines) == 0)
        | whole.rlike(CAPTION_START)
        | ((F.size(lines) <= 3) & F.forall(lines, lambda x: F.length(x) < 90))
        | (short & whole.rlike(r"(?i)\b(?:table|figure|appendix|survey|question|note)\b"))
        | (short & (percents >= 2))
    )


def text_strategy(two_columns: Column, fidelity: Column, landscape: Column, similarity: Column) -> Column:
    """Which order of a page's text is taken: native in two columns, for fonts, or for odd landscape pages; else sorted."""
    return (
        F.when(two_columns, "native_content_order_two_column")
        .when(fidelity, "native_content_order_font_fidelity")
        .when(landscape & (similarity < 0.9), "native_content_order_landscape")
        .otherwise("coordinate_sorted")
    )


def issue_class(explicit: Column, category: Column, assessment: Column, role: Column) -> Column:
    """The class told, if it is one; else by assessment, category and the rater's role."""
    c = T.squash(F.lower(F.coalesce(category, F.lit(""))))
    has = lambda *words: c.rlike("|".join(words))
    return (
        F.when(explicit.isin(*ISSUE_CLASSES), explicit)
        .when((assessment == "cannot_verify") | has("cannot_verify"), "cannot_verify")
        .when(role == "crossref", F.when(has("parser", "false_positive", "numbering_consistency"), "parser_artifact").otherwise("manuscript_issue"))
        .when(role == "reference", F.when(has("outdated", "metadata_typo"), "bibliography_maintenance").otherwise("reference_integrity"))
        .when(role == "copyedit", "copyedit_issue")
        .otherwise("manuscript_issue")
    )


def parser_gate(issue: Column, severity: Column, confidence: Column) -> Column:
    """blocker for a parser artifact of high severity and confidence, warning for other high or medium ones; else null."""
    return F.when(
        issue == "parser_artifact",
        F.when((severity == "high") & (confidence == "high"), "blocker").when(severity.isin("high", "medium"), "warning"),
    )


def body_coverage(severity: Column, issue: Column) -> Column:
    """Whether a report's body must treat a finding."""
    return F.coalesce(severity.isin("high", "medium") & issue.isin("manuscript_issue", "cannot_verify", "reference_integrity"), F.lit(False))
