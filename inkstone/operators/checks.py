"""Integrity checks as rows of violations: registry, sources, acceptance, coverage, selection, decisions, reports, state."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import findings as N
from ..functions import text as T
from ..session import cut, release


# Types of papers, parts of secrets' names, places of private files.
PAPER_TYPES = ("empirical_causal", "empirical_descriptive", "theory", "methods", "literature_review", "mixed", "unknown")
SECRET_PARTS = ("TOKEN", "SECRET", "PASSWORD", "PASSWD", "CREDENTIAL", "AUTH")
SECRET_FILE = r"(?i)(?:^|[._/-])(?:api[_-]?key|token|secret|password|passwd|credential|auth)(?:[._/-]|$)"
PRIVATE_PARTS, PRIVATE_STARTS = ("/raw/",), ("inputs/", "outputs/", "work/")


def registry(files: DataFrame) -> DataFrame:
    """Objects (paper_sha, path, sha256, page, kind, locator, value, content, id) of files (paper_sha, path, content, page,
    and cells, the rows of a table's cells): each file as a text_span over all its characters, or an image_region where it
    is a .png, and every table cell by row and column from 1. The id is fixed by paper, path, digest and locator; a page
    that is not told is that of the path's page_ number."""
    c = F.col
    digest = F.sha2(F.coalesce("content", F.lit("")), 256)
    numbered = F.regexp_extract("path", r"page_([0-9]+)", 1).try_cast("int")
    rows = files.withColumn("sha256", digest).withColumn("page", F.coalesce("page", numbered))
    image = c("path").endswith(".png")
    whole = rows.select(
        "paper_sha", "path", "sha256", "page", F.when(image, "image_region").otherwise("text_span").alias("kind"),
        F.when(image, "entire").otherwise(F.concat(F.lit("0-"), F.length("content").cast("string"))).alias("locator"), F.lit(None).cast("string").alias("value"), F.when(~image, c("content")).alias("content"),
    )
    if "cells" in files.columns:
        each = rows.select("paper_sha", "path", "sha256", "page", F.posexplode("cells").alias("row", "c")).select("*", F.posexplode("c").alias("col", "value"))
        locator = F.concat(F.lit("r"), (c("row") + 1).cast("string"), F.lit("c"), (c("col") + 1).cast("string"))
        whole = whole.unionByName(each.select("paper_sha", "path", "sha256", "page", F.lit("table_cell").alias("kind"), locator.alias("locator"), "value", c("value").alias("content")))
    key = F.concat_ws("\n", "paper_sha", "path", "sha256", "locator")
    return whole.withColumn("id", F.concat(F.lit("OBJ-"), F.substring(F.sha2(key, 256), 1, 24)))


def source_errors(sources: DataFrame, objects: DataFrame) -> DataFrame:
    """(source_id, errors): sources whose object, path, file digest, page or quote isn't what the registry holds. A source that
    has a `mode` other than text quotes nothing. An object that the registry tells twice is one, of its smallest page."""
    c = F.col
    told = lambda k: F.first(k).alias(k)
    known = objects.repartition("id").groupBy("id").agg(told("path"), told("sha256"), F.min("page").alias("page"), told("content"))
    both = sources.alias("s").join(known.alias("o"), c("s.object_id") == c("o.id"), "left")
    absent = c("o.id").isNull()
    quotes = c("s.mode").eqNullSafe("text") if "mode" in sources.columns else F.lit(True)
    rules = {
        "unknown object": absent,
        "path differs": ~absent & ~c("s.path").eqNullSafe(c("o.path")),
        "file digest differs": ~absent & ~c("s.sha256").eqNullSafe(c("o.sha256")),
        "page differs": ~absent & ~c("s.page").eqNullSafe(c("o.page")),
        "quote not found": ~absent & quotes & ~T.quote_stands(c("s.quote"), c("o.content")),
    }
    return _violations(both, [c("s.source_id").alias("source_id")], rules)


def _violations(rows: DataFrame, keys: list, rules: dict[str, Column]) -> DataFrame:
    """keys and errors, the names of the rules that a row breaks, by commas; rows that break none are left out."""
    every = F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    errors = F.array(F.array_join(F.filter(every, lambda e: e.isNotNull()), ","))
    return rows.select(*keys, F.explode(F.filter(errors, lambda e: e != "")).alias("errors"))  # a filter would test each rule twice


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """key and change (added, removed, changed) between two snapshots."""
    a, b = before.select(key, F.col(digest).alias("_a"), F.lit(1).alias("_x")), after.select(key, F.col(digest).alias("_b"), F.lit(1).alias("_y"))
    both = a.join(b, key, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")) | F.col("_x").isNull() | F.col("_y").isNull())
    return both.select(key, F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "removed").otherwise("changed").alias("change"))


def confined(path: Column) -> Column:
    """Whether a path stays below its root: relative, without parent steps, backslashes, colons or empty parts."""
    return F.coalesce(~path.rlike(r"^/|\\|:|(^|/)\.\.?(/|$)|//|^$"), F.lit(False))


def sensitive(name: Column) -> Column:
    """Whether an upper-case name says that its value is a secret: it has a secret's part that RE does not follow, or API
    before KEY."""
    parts = F.filter(F.split(F.replace(name, F.lit("-"), F.lit("_")), "_"), lambda p: p != "")
    places = F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0)))
    after = lambda i: F.coalesce(F.get(parts, i + 1), F.lit(""))
    secret = lambda i: F.get(parts, i).isin(*SECRET_PARTS) & (after(i) != "RE") | (F.get(parts, i) == "API") & (after(i) == "KEY")
    return F.coalesce((name == F.upper(name)) & F.exists(places, secret), F.lit(False))


def secret_lines(text: Column) -> Column:
    """Names, in order, that lines of a text assign to and that are secrets' names."""
    names = F.transform(F.split(text, "\n"), lambda x: F.regexp_extract(x, r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_-]*)\s*[:=]", 1))
    return F.filter(names, lambda n: (n != "") & sensitive(n))


def suspicious_files(files: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """(path, why) of files (path, content) whose name speaks of a secret or that assign to one, but for the allowed."""
    some = files.where(~F.col("path").isin(*allowed)) if allowed else files
    why = F.when(F.col("path").rlike(SECRET_FILE), "name").when(F.size(secret_lines(F.col("content"))) > 0, "assignment")
    return some.select("path", why.alias("why")).where("why is not null")


def private_path(path: Column, allowed: tuple[str, ...] = ()) -> Column:
    """Whether a shared path lies where private files do."""
    inside = lambda test, parts: [test(path, p) for p in parts]
    some = [*inside(lambda c, p: c.startswith(p), PRIVATE_STARTS), *inside(lambda c, p: c.contains(p), PRIVATE_PARTS)]
    out = some[0]
    for s in some[1:]:
        out = out | s
    return F.coalesce(out & ~path.isin(*allowed) if allowed else out, F.lit(False))


def plausible_report(report: Column, empty_run: Column, title: str, headings: tuple[str, ...], scopes: tuple[str, ...], least: int = 2000) -> Column:
    """Whether a text can be a run's report: long enough unless the run had nothing to report, with its title first, every
    heading, and one of the scope's."""
    text = F.trim(report)
    out = (F.coalesce(empty_run, F.lit(False)) | (F.length(text) >= least)) & text.startswith(title)
    for h in headings:
        out = out & text.contains(h)
    scoped = text.contains(scopes[0])
    for h in scopes[1:]:
        scoped = scoped | text.contains(h)
    return F.coalesce(out & scoped, F.lit(False))


def empty_runs(outputs: DataFrame, findings: DataFrame) -> DataFrame:
    """(run, empty): whether every rater's output (run, name, run_status, finding_count) is sound and none found anything."""
    c = F.col
    fine = outputs.groupBy("run").agg(F.bool_and(F.coalesce((c("run_status") == "ok") & (c("finding_count") == 0), F.lit(False))).alias("fine"))
    some = findings.select("run").distinct().withColumn("_found", F.lit(True))
    return fine.join(some, "run", "left").select("run", (c("fine") & c("_found").isNull()).alias("empty"))


def acceptance_errors(reviews: DataFrame) -> DataFrame:
    """(rater, paper_id, errors) of reviews (run_status, version, state, scope, missing_checks, checks, n_findings,
    limitations) that can't count as completed."""
    c = F.col
    return _violations(
        reviews,
        ["paper_id", "rater"],
        {
            "status": ~F.coalesce(c("run_status").isin("ok", "cannot_verify"), F.lit(False)),
            "version": ~c("version").eqNullSafe(F.lit(1)),
            "state": ~F.coalesce(c("state").isin("complete", "not_applicable"), F.lit(False)),
            "scope": F.trim(F.coalesce("scope", F.lit(""))) == "",
            "missing checks": F.coalesce(F.size("missing_checks"), F.lit(1)) != 0,
            "no checks": (F.coalesce(F.size("checks"), F.lit(0)) <= 0) | F.exists("checks", lambda x: F.trim(x) == ""),
            "inapplicable": (c("state") == "not_applicable") & ((c("n_findings") > 0) | (c("run_status") != "ok")),
            "limitations": (c("run_status") == "cannot_verify") & (F.trim(F.coalesce("limitations", F.lit(""))) == ""),
        },
    )


def selection_errors(roster: DataFrame, selections: DataFrame, told: DataFrame, mode: str = "applicability") -> DataFrame:
    """(paper_id, subject, error), each once, of selections (paper_id, about, paper_type, confidence, mode) with what is told
    of raters (paper_id, name, reason, selected), against a roster (name, enabled, optional)."""
    c = F.col
    outside = lambda name, values: ~F.coalesce(c(name).isin(*values), F.lit(False))
    own = {
        "paper": ~c("about").eqNullSafe(c("paper_id")), "paper type": outside("paper_type", PAPER_TYPES),
        "confidence": outside("confidence", ("high", "medium", "low")), "mode": ~c("mode").eqNullSafe(F.lit(mode)),
    }
    every = lambda rules: F.explode(F.array_compact(F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()])))
    out = selections.select("paper_id", F.lit(None).cast("string").alias("subject"), every(own).alias("error"))
    known = roster.select("name", F.coalesce(c("enabled") & c("optional"), F.lit(False)).alias("_open"), F.coalesce(~c("optional"), F.lit(False)).alias("_mandatory"))
    counts = told.groupBy("paper_id", "name").agg(
        F.count_if("selected").alias("s"), F.count_if(~c("selected")).alias("k"), F.bool_or(F.trim(F.coalesce("reason", F.lit(""))) == "").alias("bare")
    ).join(known, "name", "left")
    named = {
        "no reason": c("bare"), "mandatory": (c("s") > 0) & c("_mandatory"), "not in roster": ~F.coalesce("_open", F.lit(False)), "selected twice": c("s") > 1,
        "skipped twice": c("k") > 1, "selected and skipped": (c("s") > 0) & (c("k") > 0),
    }
    out = out.unionByName(counts.select("paper_id", c("name").alias("subject"), every(named).alias("error")))
    names = known.where("_open").agg(F.collect_list("name").alias("_names"))  # one row
    due = selections.select("paper_id").crossJoin(names).select("paper_id", F.explode("_names").alias("name"))
    missing = due.join(told.select("paper_id", "name").distinct(), ["paper_id", "name"], "left_anti")
    return out.unionByName(missing.select("paper_id", c("name").alias("subject"), F.lit("unaccounted").alias("error"))).distinct()


def guarded_selection(roster: DataFrame, selection: DataFrame) -> DataFrame:
    """(paper_id, name): mandatory raters, the selected ones, all where the paper's type or the confidence is unsure,
    and the theory rater of theory papers."""
    c = F.col
    unsure = c("paper_type").isin("mixed", "unknown") | ~c("confidence").eqNullSafe(F.lit("high"))
    theory = (c("paper_type") == "theory") & (c("name") == "theory_logic_auditor")
    names = roster.where("enabled").agg(F.collect_list(F.struct("name", "optional")).alias("_names"))  # one row
    some = selection.crossJoin(names).select("*", F.inline("_names"))
    return some.where(~c("optional") | unsure | theory | F.array_contains("selected", c("name"))).select("paper_id", "name")


def terminals(decisions: DataFrame) -> DataFrame:
    """(id, terminal, steps, error) of merged decisions (id, disposition, destination): the end of each merge chain, by
    doubling, so a chain of n takes log n joins, each on a checkpointed table. Chains are followed until a round brings none
    to its end: a chain that is longer has a part that ends in that round, so what still moves is led into a ring, and rounds
    grow with the longest chain and not with the rows. One that ends nowhere, in a rejection or in a ring has an error and no
    terminal."""
    c = F.col
    merged = decisions.where(c("disposition") == "merged")
    jump = cut(merged.select("id", c("destination").alias("at"), F.lit(1).cast("long").alias("steps"), F.lit(True).alias("moved")))
    moving, left = None, jump.select("id").distinct().count()
    while left and left != moving:
        far = jump.select(c("id").alias("at"), c("at").alias("far"), c("steps").alias("more"))
        on = F.coalesce("far", "at").alias("at"), (c("steps") + F.coalesce("more", F.lit(0))).alias("steps"), c("far").isNotNull().alias("moved")
        before, jump = jump, cut(jump.join(far, "at", "left").select("id", *on))
        release(before)
        moving, left = left, jump.where("moved").select("id").distinct().count()
    ends = decisions.select(c("id").alias("at"), c("disposition").alias("_d"))
    out = jump.join(ends, "at", "left")
    error = F.when(c("_d").isNull(), "unknown destination").when(c("_d") == "merged", "cycle").when(c("_d") == "rejected", "rejected")
    return out.select("id", error.alias("error"), F.when(error.isNull(), c("at")).alias("terminal"), F.when(error.isNull(), c("steps")).alias("steps"))


def rendered(blocks: DataFrame) -> DataFrame:
    """(paper_id, report): blocks in order, a heading where the section changes. A report is a paper's, which bounds it."""
    order = Window.partitionBy("paper_id").orderBy("place")
    new = ~F.col("section").eqNullSafe(F.lag("section").over(order))
    part = F.concat(F.when(new, F.concat(F.lit("## "), "section", F.lit("\n\n"))).otherwise(""), F.col("markdown"))
    rows = blocks.withColumn("part", part)
    ordered = F.array_sort(F.collect_list(F.struct("place", "part")))
    return rows.groupBy("paper_id").agg(F.array_join(F.transform(ordered, lambda p: p["part"]), "\n\n").alias("report"))


def render_template(template: Column, values: dict[str, Column]) -> Column:
    """The template with {name} replaced, null if a placeholder is left: every one must be known."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    left = F.regexp_replace(template, "|".join(r"\{" + n + r"\}" for n in values) or "$^", "")
    return F.when(~left.rlike(r"\{[a-zA-Z_]\w*\}"), out)


def page_quality(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys and a paper's page counts and lists, as its quality summary: low, sparse, short and long pages, median."""
    n = F.length(F.trim("text"))
    low = n < 250
    ordered = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("page")))), ",")
    return pages.groupBy(*keys).agg(
        F.count("*").alias("n_pages"), ordered(low).alias("low_text_pages"), F.count_if(~low).alias("n_full"),
        F.round(F.percentile(n, F.lit(0.5)), 3).alias("median_chars"), F.max(n).alias("longest"),
    )


def run_score(low: Column, unstable: Column, scanned: Column, ratio: Column) -> Column:
    """A run's page score: 100 less penalties, from 0 to 100."""
    off = F.when((ratio < 0.65) | (ratio > 1.35), 20.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - 4.0 * low - 3.0 * unstable - 1.5 * scanned - off))


def task_state(attempts: DataFrame, most: int = 3) -> DataFrame:
    """(task, status, attempts): accepted if any attempt is; else exhausted after `most` failures, else what the last one
    says: retry after a failure, inflight while it runs. Aggregates only; the last comes by its time and number."""
    last = F.max_by("kind", F.struct("ts", "attempt"))
    out = attempts.groupBy("task").agg(F.bool_or(F.col("kind") == "accept").alias("ok"), F.count_if(F.col("kind") == "fail").alias("fails"), last.alias("last"), F.count("*").alias("attempts"))
    status = F.when(F.col("ok"), "accepted").when(F.col("fails") >= most, "exhausted").when(F.col("last") == "fail", "retry").otherwise("inflight")
    return out.select("task", status.alias("status"), "attempts")


def fresh(outputs: DataFrame) -> DataFrame:
    """Outputs with `accepted`: one written before its attempt began is left over from another run."""
    return outputs.withColumn("accepted", F.coalesce(F.col("modified") >= F.col("started"), F.lit(False)))


def stale(listing: DataFrame, keep: DataFrame, prefix: str) -> DataFrame:
    """Numbered files of the prefix that aren't to be kept; nothing is deleted."""
    return listing.where(F.col("path").rlike(rf"(^|/){prefix}_[0-9]+\.[^/]+$")).join(keep.select("path"), "path", "left_anti")


def archive_errors(members: DataFrame, most: int = 20_000, most_bytes: int = 2_000_000_000) -> DataFrame:
    """(archive, errors) of archives with too many members or bytes, names that differ in case alone, or paths outside."""
    names = members.groupBy("archive", F.lower("path").alias("_p")).agg(F.count("*").alias("_n"), F.sum("bytes").alias("_b"), F.bool_or(~confined(F.col("path"))).alias("_out"))
    sums = names.groupBy("archive").agg(F.sum("_n").alias("n"), F.sum("_b").alias("b"), F.max("_n").alias("same"), F.bool_or("_out").alias("out"))
    return _violations(sums, ["archive"], {"members": F.col("n") > most, "bytes": F.col("b") > most_bytes, "case": F.col("same") > 1, "outside": F.col("out")})


def greedy_ranges(lines: DataFrame, keys: list[str], most_bytes: int = 48_000, most_lines: int = 800) -> DataFrame:
    """keys, range, first, last, bytes: lines packed in order into ranges of so many bytes and lines at most; a longer line is
    a range of its own. The reset of the running sum is a fold over a document's line sizes (numbers, not texts), whose list
    of closed ranges is touched only where one closes."""
    sizes = F.array_sort(F.collect_list(F.struct("line", (F.octet_length("content") + 1).cast("long").alias("n"))))
    one = "struct<first:int,last:int,bytes:long>"
    state = f"struct<done:array<{one}>,now:{one}>"
    start = F.from_json(F.lit('{"done": []}'), state)

    def step(s: Column, x: Column) -> Column:
        now = s["now"]
        fits = F.coalesce((now["bytes"] + x["n"] <= most_bytes) & (x["line"] - now["first"] < most_lines), F.lit(False))
        grown = F.struct(now["first"].alias("first"), x["line"].alias("last"), (now["bytes"] + x["n"]).alias("bytes"))
        fresh = F.struct(x["line"].alias("first"), x["line"].alias("last"), x["n"].alias("bytes"))
        done = F.when(fits | now.isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(now)))
        return F.struct(done.alias("done"), F.when(fits, grown).otherwise(fresh).alias("now")).cast(state)

    ends = lambda s: F.concat(s["done"], F.array(s["now"]))
    folded = lines.groupBy(*keys).agg(F.aggregate(sizes, start, step, ends).alias("r"))
    return folded.select(*keys, F.posexplode("r").alias("range", "x")).select(*keys, "range", "x.first", "x.last", "x.bytes")


def roster_status(roster: DataFrame, outputs: DataFrame, reasons: DataFrame) -> DataFrame:
    """(name, findings, status, reason) of every rater, with defaults where there is no output or reason."""
    counts = outputs.groupBy("name").agg(F.count("*").alias("_n"))
    out = roster.select("name").join(counts, "name", "left").join(reasons.select("name", F.col("reason").alias("_r")), "name", "left")
    return out.select(
        "name", F.coalesce("_n", F.lit(0)).alias("findings"), F.when(F.col("_n").isNull(), "no output").otherwise("ok").alias("status"),
        F.coalesce("_r", F.lit("selected by rater applicability routing")).alias("reason"),
    )


def finding_errors(findings: DataFrame, roster: DataFrame, sources: DataFrame, links: DataFrame) -> DataFrame:
    """(paper_id, rater, id, error), each once, of findings (paper_id, rater, id, issue_type, category, severity, confidence,
    assessment, finding_summary, page, page_label, section, text_quote, precision, cannot_verify_reason, numeric_check) that
    break the contract, with their sources (paper_id, rater, id, source_id, url, path, page) and links (paper_id, rater, id,
    link, source_id; a null source_id is an empty link), against a roster (rater, id_prefix) and the paper's pages
    (findings.page_count)."""
    c, key = F.col, ["paper_id", "rater", "id"]
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    outside = lambda name, *values: ~F.coalesce(c(name).isin(*values), F.lit(False))
    known = findings.join(roster.select("rater", "id_prefix"), "rater", "left")
    times = findings.groupBy(*key).agg(F.count("*").alias("_times"))
    have = sources.groupBy(*key).agg(F.count("*").alias("_sources"))
    rows = known.join(times, key, "left").join(have, key, "left")
    unverifiable = N.unverifiable_in_contract(c("assessment"), c("issue_type"), c("category"))
    placed = F.coalesce(c("page").cast("string"), c("page_label"), c("section"), c("text_quote")).isNotNull()
    rules = {
        "rater": c("id_prefix").isNull(), "duplicate id": c("_times") > 1, "id": c("id_prefix").isNotNull() & ~F.regexp(c("id"), F.concat(F.lit("^"), "id_prefix", F.lit("-[0-9]{3}$"))),
        "issue type": blank(c("issue_type")), "severity": outside("severity", "low", "medium", "high"), "confidence": outside("confidence", "low", "medium", "high"),
        "assessment": outside("assessment", "yes", "no", "partially", "cannot_verify"), "summary": blank(c("finding_summary")), "precision": blank(c("precision")),
        "placed but missing": (c("precision") == "missing") & placed, "exact but nowhere": (c("precision") == "exact") & ~placed,
        "page": ~c("page").between(1, c("page_count")), "no reason": unverifiable & blank(c("cannot_verify_reason")), "no sources": ~unverifiable & c("_sources").isNull(),
        "no numeric check": (c("rater") == "numerical_auditor") & ~c("issue_type").eqNullSafe(F.lit("parser_artifact")) & ~unverifiable & blank(c("numeric_check")),
        "empty numeric check": c("numeric_check").rlike(r'^\{\s*(?:"[^"]*"\s*:\s*(?:null|""|\[\])\s*,?\s*)*\}$'),
    }
    told = lambda df, some: df.select(*key, F.explode(F.array_compact(F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in some.items()]))).alias("error"))
    pages = findings.groupBy("paper_id").agg(F.max("page_count").alias("page_count"))
    sound = {
        "source url": c("url").isNotNull() & ~c("url").rlike(r"^https://[^\s]+$"), "source path": c("path").isNotNull() & ~confined(c("path")),
        "source place": c("url").isNull() & c("path").isNull(), "source page": ~c("page").between(1, c("page_count")),
    }
    out = told(rows, rules).unionByName(told(sources.join(pages, "paper_id", "left"), sound))
    bare = links.where(c("source_id").isNull()).select(*key, F.lit("empty link").alias("error"))
    loose = links.where(c("source_id").isNotNull()).join(sources.select(*key, "source_id"), [*key, "source_id"], "left_anti").select(*key, F.lit("link to unknown source").alias("error"))
    return out.unionByName(bare).unionByName(loose).distinct()


def verification_errors(verifications: DataFrame, chosen: DataFrame, results: DataFrame, evidence: DataFrame, objects: DataFrame) -> DataFrame:
    """(packet, subject, error), each once, of second looks: verifications (packet, version, status, packet_sha, expected_sha);
    results (packet, id, outcome, reason, strongest_alternative, observation, diagnosis, remedy, editor_fidelity,
    editor_reason, surviving_claim) for the ids that were chosen (packet, id); evidence (packet, id, object_id,
    correspondence, quote) against objects (object_id, content)."""
    c = F.col
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    told = lambda df, subject, rules: df.select("packet", subject.alias("subject"), F.explode(F.array_compact(F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()]))).alias("error"))
    whole = {"version": ~c("version").eqNullSafe(F.lit(1)), "status": ~c("status").eqNullSafe(F.lit("complete")), "packet": ~c("packet_sha").eqNullSafe(c("expected_sha"))}
    out = told(verifications, F.lit(None).cast("string"), whole)
    have = evidence.groupBy("packet", "id").agg(F.count("*").alias("_n"), F.bool_or(c("correspondence") == "unresolved").alias("_open"))
    times = results.groupBy("packet", "id").agg(F.count("*").alias("_times"))
    wanted = chosen.select("packet", "id").distinct().withColumn("_chosen", F.lit(True))
    rows = results.join(times, ["packet", "id"]).join(have, ["packet", "id"], "left").join(wanted, ["packet", "id"], "left")
    own = {
        "outcome": ~F.coalesce(c("outcome").isin("confirmed", "narrowed", "rejected", "unresolved"), F.lit(False)), "not chosen": c("_chosen").isNull(), "duplicate": c("_times") > 1,
        "account": blank(c("reason")) | blank(c("strongest_alternative")) | blank(c("observation")) | blank(c("diagnosis")) | blank(c("remedy")),
        "fidelity": ~F.coalesce(c("editor_fidelity").isin("faithful", "not_faithful", "unresolved", "not_applicable"), F.lit(False)), "fidelity reason": blank(c("editor_reason")),
        "surviving claim": (c("outcome") == "narrowed") & blank(c("surviving_claim")), "evidence": (c("outcome") != "unresolved") & (F.coalesce("_n", F.lit(0)) == 0),
        "unavailable evidence": (c("outcome") != "unresolved") & c("_open"),
    }
    out = out.unionByName(told(rows, c("id"), own))
    missing = wanted.join(results.select("packet", "id"), ["packet", "id"], "left_anti").select("packet", c("id").alias("subject"), F.lit("missing").alias("error"))
    both = evidence.join(objects.select("object_id", "content", F.lit(True).alias("_known")), "object_id", "left")
    bad = told(both, c("id"), {"unknown object": c("_known").isNull(), "quote": (c("correspondence") == "text") & c("_known").isNotNull() & ~T.quote_stands(c("quote"), c("content"))})
    return out.unionByName(missing).unionByName(bad).distinct()
