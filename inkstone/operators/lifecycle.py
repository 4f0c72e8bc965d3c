"""Runs over their life: repairs, resumption, derived runs, leases, choices, layout and bounded selections, as rows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import confined, snapshot_diff

# Where the parts of a paper's run lie, and their files.
FOLDERS = {
    "parsed": "work/{paper}/parsed", "prompts": "work/{paper}/prompts", "reviews": "work/{paper}/reviews", "editor": "work/{paper}/editor",
    "selection": "work/{paper}/selection", "logs": "work/{paper}/logs", "outputs": "outputs/{paper}",
}
FILES = {
    "bundle": "work/{paper}/editor/normalized_bundle.json", "editor_prompt": "work/{paper}/prompts/editor_report.txt", "editor_input": "work/{paper}/editor/editor_input.md",
    "report": "outputs/{paper}/report.md", "run_manifest": "work/{paper}/run_manifest.json",
}


def layout(papers: DataFrame, paper: str = "paper_id") -> DataFrame:
    """(paper, part, path) of every folder and file of each paper's run."""
    parts = F.array(*[F.struct(F.lit(part).alias("part"), F.lit(path).alias("path")) for part, path in (FOLDERS | FILES).items()])
    rows = papers.select(paper).distinct().select(paper, F.explode(parts).alias("p"))
    return rows.select(paper, "p.part", F.replace(F.col("p.path"), F.lit("{paper}"), F.col(paper)).alias("path"))


def portable(path: Column, root: Column) -> Column:
    """The path below its root with forward slashes; as it is where it lies elsewhere."""
    slashed, base = F.replace(path, F.lit("\\"), F.lit("/")), F.regexp_replace(F.replace(root, F.lit("\\"), F.lit("/")), "/+$", "")
    inside = slashed.startswith(F.concat(base, F.lit("/")))
    return F.when(slashed == base, ".").when(inside, F.substring(slashed, F.length(base) + 2, F.length(slashed))).otherwise(slashed)


def repair_grants(requests: DataFrame, run: str = "run") -> DataFrame:
    """requests (run, place, stage, cap) with number and refused: of each run's requests in order the first of a stage is
    granted, as long as the run's cap allows; a refused one has a reason and no number. Grants are counted over first
    requests alone, so that a stage asked for again uses nothing up."""
    c = F.col
    sound = c("stage").rlike(r"^[a-z][a-z0-9_]*$") & (c("cap") >= 0)
    marked = requests.withColumn("_sound", F.coalesce(sound, F.lit(False)))
    again = F.row_number().over(Window.partitionBy(run, "stage", "_sound").orderBy("place")) > 1
    marked = marked.withColumn("_again", again)
    counts = c("_sound") & ~c("_again")
    so_far = Window.partitionBy(run).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("_n", F.sum(counts.cast("int")).over(so_far))
    refused = F.when(~c("_sound"), "invalid").when(c("_again"), "stage repaired before").when(c("_n") > c("cap"), "cap reached")
    return marked.withColumn("refused", refused).withColumn("number", F.when(c("refused").isNull(), c("_n"))).drop("_sound", "_again", "_n")


def resume_errors(checkpoints: DataFrame, runs: DataFrame, saved: DataFrame, now: DataFrame, accepted: DataFrame, roster: DataFrame, policy: int = 2) -> DataFrame:
    """(run, error, item), each once: why a checkpoint can't be resumed.

    checkpoints (run, format, settings) against runs (run, settings); saved files (run, path, sha256) against those that are
    there now; accepted outputs (run, name, sha256) against the roster (run, name, sha256 of the output now).
    """
    c = F.col
    row = lambda df, error, item: df.select("run", F.lit(error).alias("error"), item.cast("string").alias("item"))
    both = runs.alias("r").join(checkpoints.alias("k"), "run", "left")
    none = row(both.where(c("k.format").isNull()), "no checkpoint", F.lit(None))
    old = row(both.where(c("k.format") != policy), "older policy", c("k.format"))
    other = row(both.where(c("k.format").isNotNull() & ~c("k.settings").eqNullSafe(c("r.settings"))), "settings differ", F.lit(None))
    key = lambda df: df.select(F.struct("run", "path").alias("path"), "sha256")
    changed = snapshot_diff(key(saved), key(now))
    files = changed.select(c("path.run").alias("run"), F.concat(F.lit("file "), "change").alias("error"), c("path.path").alias("item"))
    known = accepted.alias("a").join(roster.alias("o"), ["run", "name"], "left")
    unknown = row(known.where(c("o.sha256").isNull()), "unknown accepted", c("name"))
    differs = row(known.where(c("a.sha256") != c("o.sha256")), "accepted output changed", c("name"))
    return none.union(old).union(other).union(files).union(unknown).union(differs).distinct()


def remaining(roster: DataFrame, accepted: DataFrame, errors: DataFrame) -> DataFrame:
    """(run, name) that a resumed run still has to do: what was not accepted, in runs that can be resumed."""
    sound = roster.join(errors.select("run").distinct(), "run", "left_anti")
    return sound.join(accepted.select("run", "name"), ["run", "name"], "left_anti").select("run", "name")


def derivation_errors(derived: DataFrame, names: DataFrame) -> DataFrame:
    """(child, errors) of runs derived from others that break a rule, the rules' names by commas.

    derived is (child, paper_id, parent, status, has_receipts, child_exists, repairs, manifest_settings, accepted_settings,
    manifest_sha256, accepted_sha256, copied_sha256); names (child, name, expected, accepted) of the parent's roster.
    """
    c = F.col
    under = lambda a, b: F.concat(F.regexp_replace(a, "/+$", ""), F.lit("/")).startswith(F.concat(F.regexp_replace(b, "/+$", ""), F.lit("/")))
    odd = names.groupBy("child").agg(F.bool_or(~c("expected").eqNullSafe(c("accepted"))).alias("_odd"))
    rows = derived.join(odd, "child", "left")
    rules = {
        "paper": ~F.coalesce(confined(c("paper_id")) & ~c("paper_id").contains("/"), F.lit(False)),
        "nested": under(c("child"), c("parent")) | under(c("parent"), c("child")),
        "exists": F.coalesce("child_exists", F.lit(False)),
        "repairs": c("repairs") < 0,
        "parent unfinished": ~c("status").eqNullSafe(F.lit("complete")) | ~F.coalesce("has_receipts", F.lit(False)),
        "roster": F.coalesce("_odd", F.lit(False)),
        "settings": ~c("manifest_settings").eqNullSafe(c("accepted_settings")),
        "source": ~c("manifest_sha256").eqNullSafe(c("accepted_sha256")),
        "changed while copying": ~c("copied_sha256").eqNullSafe(c("accepted_sha256")),
    }
    every = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return rows.select("child", F.array_join(every, ",").alias("errors")).where("errors <> ''")


def resolved_choice(explicit: Column, saved: Column, preference: Column, known: tuple[str, ...], default: str) -> Column:
    """struct(choice, origin, error): one of the known names; a saved run's stands, then an explicit one, then the preference,
    then the default. A name that isn't known, or an explicit one that differs from the saved, is an error, never replaced."""
    bad = lambda x: x.isNotNull() & ~x.isin(*known)
    error = (
        F.when(bad(explicit), "unknown explicit choice")
        .when(bad(saved), "unknown saved choice")
        .when(saved.isNotNull() & explicit.isNotNull() & (explicit != saved), "differs from saved run")
        .when(saved.isNull() & explicit.isNull() & bad(preference), "unknown preference")
    )
    origin = F.when(explicit.isNotNull(), "explicit choice").when(saved.isNotNull(), "saved run").when(preference.isNotNull(), "preference").otherwise("default")
    choice = F.coalesce(saved, explicit, preference, F.lit(default))
    none = F.lit(None).cast("string")
    return F.struct(F.when(error.isNull(), choice).otherwise(none).alias("choice"), F.when(error.isNull(), origin).otherwise(none).alias("origin"), error.alias("error"))


def lease_conflicts(leases: DataFrame, key: str = "run") -> DataFrame:
    """(key, holder, began, other) of leases (key, holder, began, ended) that began while an earlier one of the key was still
    held, the longest of those; an open lease has no end. Leases are told by their beginning, then their holder."""
    c = F.col
    before = Window.partitionBy(key).orderBy("began", "holder").rowsBetween(Window.unboundedPreceding, -1)
    end = F.coalesce("ended", F.lit("9999-12-31").cast("timestamp"))
    longest = F.max(F.struct(end.alias("end"), c("holder").alias("holder"))).over(before)
    rows = leases.withColumn("_last", longest)
    return rows.where(c("_last.end") > c("began")).select(key, "holder", "began", c("_last.holder").alias("other"))


def selection_guard(chosen: DataFrame, findings: DataFrame, most: int = 5) -> DataFrame:
    """(packet, errors) of preselections (packet, paper_id, id) that are not one to `most` different known findings of high or
    medium severity; the rules' names by commas."""
    c = F.col
    known = findings.select("paper_id", "id", "severity").distinct().withColumn("_known", F.lit(True))
    rows = chosen.join(known, ["paper_id", "id"], "left").groupBy("packet").agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("d"), F.bool_and(c("_known").isNotNull()).alias("all_known"),
        F.bool_and(F.coalesce(c("severity").isin("high", "medium"), F.lit(True))).alias("all_material"),
    )
    rules = {"number": ~c("n").between(1, most), "repeated": c("d") < c("n"), "unknown": ~c("all_known"), "minor": ~c("all_material")}
    every = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return rows.select("packet", F.array_join(every, ",").alias("errors")).where("errors <> ''")
