"""Offline benchmark scoring: schedule, cell metrics, macro averages, usage logs, input checks."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def schedule(cases: DataFrame, profiles: DataFrame, repeats: int, seed: int) -> DataFrame:
    """(case, role, profile, repeat, job): every case and role under every profile, repeated, in an order that the seed
    fixes. cases has (case, roles); the few profiles are one list, so no join is needed."""
    names = sorted(r["profile"] for r in profiles.select("profile").distinct().collect())  # a handful by definition
    jobs = cases.select("case", F.explode("roles").alias("role"), F.lit(names).alias("profiles"))
    jobs = jobs.select("case", "role", F.explode("profiles").alias("profile"))
    jobs = jobs.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    key = F.xxhash64(F.lit(seed), "case", "role", "profile", "repeat")
    return jobs.withColumn("job", F.format_string("j%016x", key))


def first_ratings(ratings: DataFrame) -> DataFrame:
    """Of each sample and issue the first row by row number; pre-aggregated, no sort."""
    rest = [c for c in ratings.columns if c not in ("sample_id", "issue_key")]
    first = ratings.groupBy("sample_id", "issue_key").agg(F.min_by(F.struct(*rest), "row").alias("r"))
    return first.select("sample_id", "issue_key", "r.*")


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; unknown where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def cell_metrics(samples: DataFrame, ratings: DataFrame, truth: DataFrame) -> DataFrame:
    """A row for each complete sample: unique issues by verdict, precision and its bounds, recall, evidence, actionability."""
    done = samples.where("status = 'complete'")
    unique = first_ratings(ratings)
    verdict = lambda v: F.count_if(F.col("verdict") == v)
    by_issue = unique.groupBy("sample_id").agg(
        verdict("confirmed").alias("confirmed_unique"),
        verdict("false_positive").alias("false_positive_unique"),
        verdict("unresolved").alias("unresolved_unique"),
        F.count("*").alias("n_unique"),
    )
    by_row = ratings.groupBy("sample_id").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("evidence_correct") == "true").alias("n_true"),
        F.count_if(F.col("evidence_correct") != "unknown").alias("n_checked"),
        F.avg("actionability").alias("mean_actionability"),
    )
    scoped = done.join(truth.where("status = 'confirmed'").withColumnRenamed("status", "_s"), "case").where(F.array_contains("roles", F.col("role")))
    confirmed = unique.where("verdict = 'confirmed'").select("sample_id", "issue_key", F.lit(1).alias("hit"))
    known = scoped.join(confirmed, ["sample_id", "issue_key"], "left").groupBy("sample_id").agg(
        F.count("*").alias("reference_issue_count"),
        F.count("hit").alias("reference_hits"),
        F.sum("weight").alias("_all"),
        F.sum(F.when(F.col("hit") == 1, F.col("weight")).otherwise(0)).alias("_hit"),
    )
    out = done.join(by_issue, "sample_id", "left").join(by_row, "sample_id", "left").join(known, "sample_id", "left")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0)).cast("long")
    c, f, u = zero("confirmed_unique"), zero("false_positive_unique"), zero("unresolved_unique")
    return out.select(
        "sample_id", "case", "role", "profile", "repeat",
        c.alias("confirmed_unique"), f.alias("false_positive_unique"), u.alias("unresolved_unique"),
        (zero("n_rows") - zero("n_unique")).alias("duplicate_rows"),
        ratio(c, c + f).alias("precision_resolved"),
        ratio(c, c + f + u).alias("precision_lower"),
        ratio(c + u, c + f + u).alias("precision_upper"),
        zero("reference_issue_count").alias("reference_issue_count"),
        zero("reference_hits").alias("reference_hits"),
        ratio(zero("reference_hits"), zero("reference_issue_count")).alias("recall"),
        ratio(F.coalesce("_hit", F.lit(0)), F.coalesce("_all", F.lit(0))).alias("weighted_recall"),
        ratio(zero("n_true"), zero("n_checked")).alias("evidence_accuracy"),
        "mean_actionability",
    )


def macro_metrics(samples: DataFrame, cells: DataFrame) -> DataFrame:
    """A row for each profile: planned, attempted, complete, and means over cells that all profiles completed."""
    profiles = samples.agg(F.count_distinct("profile").alias("_n"))
    key = ["case", "role", "repeat"]
    complete = samples.where("status = 'complete'").groupBy(*key).agg(F.count_distinct("profile").alias("_done"))
    paired = complete.join(F.broadcast(profiles), F.col("_done") == F.col("_n")).select(*key)  # one row, the number
    matched = cells.join(paired, key, "left_semi")
    mean = matched.groupBy("profile").agg(
        F.count("*").alias("matched_cells"),
        F.avg("precision_resolved").alias("precision_macro"),
        F.count("precision_resolved").alias("precision_cells"),
        F.avg("recall").alias("recall_macro"),
        F.count("recall").alias("recall_cells"),
    )
    plan = samples.groupBy("profile").agg(
        F.count("*").alias("planned"),
        F.count_if(F.col("status") != "not-run").alias("attempted"),
        F.count_if(F.col("status") == "complete").alias("complete"),
    )
    out = plan.join(mean, "profile", "left").fillna(0, ["matched_cells", "precision_cells", "recall_cells"])
    return out.withColumn("completion_rate", ratio(F.col("complete"), F.col("attempted")))


def rating_errors(ratings: DataFrame, findings: DataFrame) -> DataFrame:
    """(sample_id, key, error): ratings missing, extra or repeated, of unknown verdict, or at odds over one issue."""
    rated = ratings.groupBy("sample_id", "finding_id").agg(F.count("*").alias("_n"))
    expected = findings.select("sample_id", "finding_id").distinct().withColumn("_expected", F.lit(True))
    both = rated.join(expected, ["sample_id", "finding_id"], "full_outer")
    error = F.when(F.col("_n").isNull(), "missing").when(F.col("_expected").isNull(), "extra").when(F.col("_n") > 1, "duplicate")
    counts = both.select("sample_id", F.col("finding_id").cast("string").alias("key"), error.alias("error")).where("error is not null")
    unknown = ratings.where(~F.col("verdict").isin("confirmed", "false_positive", "unresolved", "suggestion") | F.col("verdict").isNull())
    unknown = unknown.select("sample_id", F.col("finding_id").cast("string").alias("key"), F.lit("verdict").alias("error"))
    odds = ratings.groupBy("sample_id", "issue_key").agg(F.count_distinct("verdict").alias("_v")).where("_v > 1")
    return counts.union(unknown).union(odds.select("sample_id", F.col("issue_key").alias("key"), F.lit("conflict").alias("error")))


def usage(log: DataFrame, job: str = "job", line: str = "line") -> DataFrame:
    """(job, status, input_total, input_cached, input_uncached, output) of JSON log lines: exactly one completed turn
    with sound counters is reported, more or none is ambiguous, anything unsound is unavailable. Unknown stays null."""
    schema = "type string, usage struct<input_tokens:long,cached_input_tokens:long,output_tokens:long>"
    read = log.withColumn("e", F.from_json(line, schema)).withColumn("bad", F.try_parse_json(line).isNull() & (F.trim(line) != ""))
    turn = (F.col("e.type") == "turn.completed") & F.col("e.usage").isNotNull()
    one = read.groupBy(job).agg(
        F.count_if(turn).alias("turns"), F.max(F.when(turn, F.col("e.usage"))).alias("u"), F.bool_or("bad").alias("bad")
    )
    total, cached, out = F.col("u.input_tokens"), F.col("u.cached_input_tokens"), F.col("u.output_tokens")
    sound = F.coalesce((total >= 0) & (cached >= 0) & (out >= 0) & (cached <= total), F.lit(False))
    status = F.when(F.col("bad"), "unavailable").when(F.col("turns") != 1, "ambiguous-or-incomplete")
    rows = one.withColumn("status", status.when(sound, "reported").otherwise("unavailable"))
    only = lambda c: F.when(F.col("status") == "reported", c)
    return rows.select(
        job, "status", only(total).alias("input_total"), only(cached).alias("input_cached"),
        only(total - cached).alias("input_uncached"), only(out).alias("output"),
    )


def cost_usage(log: DataFrame, job: str = "job", document: str = "document") -> DataFrame:
    """(job, status, input_uncached, input_cached, input_cache_write, output, input_total) of jobs whose log is one JSON
    document with usage; whole numbers from 0 on in all four counters, or unavailable with none."""
    names = ("input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "output_tokens")
    whole = lambda n: F.get_json_object(document, f"$.usage.{n}")
    read = log.select(job, *[F.when(whole(n).rlike("^[0-9]+$"), whole(n).try_cast("long")).alias(n) for n in names])
    sound = F.forall(F.array(*names), lambda x: x.isNotNull())
    only = lambda c: F.when(sound, c)
    uncached, cached, written, out = (F.col(n) for n in names)
    return read.select(
        job, F.when(sound, "reported").otherwise("unavailable").alias("status"), only(uncached).alias("input_uncached"), only(cached).alias("input_cached"),
        only(written).alias("input_cache_write"), only(out).alias("output"), only(uncached + cached + written).alias("input_total"),
    )


def config_errors(configs: DataFrame, items: DataFrame, truth: DataFrame, efforts: tuple[str, ...] = ("low", "medium", "high", "xhigh", "max")) -> DataFrame:
    """(config, subject, error), each once, of benchmark plans: configs (config, format, repeats, timeout_minutes); items
    (config, kind of profile or case, id, model, effort, roles, pdf_sha, parsed_sha); truth (config, case, issue_key, source,
    roles, weight, status), of which the confirmed are held to the rules."""
    c = F.col
    told = lambda df, subject, rules: df.select("config", subject.alias("subject"), F.explode(F.array_compact(F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()]))).alias("error"))
    kinds = items.groupBy("config").agg(F.count_if(c("kind") == "profile").alias("_profiles"), F.count_if(c("kind") == "case").alias("_cases"))
    whole = configs.join(kinds, "config", "left")
    none = F.lit(None).cast("string")
    out = told(whole, none, {
        "format": ~c("format").eqNullSafe(F.lit(1)), "repeats": ~F.coalesce(c("repeats").between(1, 10), F.lit(False)),
        "timeout": ~F.coalesce((c("timeout_minutes") > 0) & (c("timeout_minutes") <= 120), F.lit(False)), "nothing to compare": (F.coalesce("_profiles", F.lit(0)) == 0) | (F.coalesce("_cases", F.lit(0)) == 0),
    })
    times = items.groupBy("config", "kind", "id").agg(F.count("*").alias("_n"))
    rows = items.join(times, ["config", "kind", "id"], "left")
    profile, case = c("kind") == "profile", c("kind") == "case"
    out = out.unionByName(told(rows, c("id"), {
        "identifier": ~F.coalesce(c("id").rlike(r"^[a-z0-9][a-z0-9-]{0,79}$"), F.lit(False)), "duplicate": c("_n") > 1, "model": profile & (F.trim(F.coalesce("model", F.lit(""))) == ""),
        "effort": profile & ~F.coalesce(c("effort").isin(*efforts), F.lit(False)), "roles": case & (F.coalesce(F.size("roles"), F.lit(0)) < 1) | case & (F.size(F.array_distinct("roles")) < F.size("roles")),
        "source": case & ~c("pdf_sha").eqNullSafe(c("parsed_sha")),
    }))
    known = truth.where("status = 'confirmed'")
    again = known.groupBy("config", "case", "issue_key").agg(F.count("*").alias("_n"))
    rows = known.join(again, ["config", "case", "issue_key"], "left")
    out = out.unionByName(told(rows, c("issue_key"), {
        "reference repeated": c("_n") > 1, "reference scope": (F.trim(F.coalesce("source", F.lit(""))) == "") | (F.coalesce(F.size("roles"), F.lit(0)) < 1),
        "weight": ~F.coalesce((c("weight") > 0) & (c("weight") <= 5), F.lit(False)),
    }))
    return out.distinct()


def blind_packet(jobs: DataFrame, seed: int, digits: int | None = None, per_bucket: int = 100_000) -> DataFrame:
    """jobs with sample_id: an order by digests of seed and job that hides profiles, numbered without gaps. The digests' first
    digits part the jobs into buckets in that order, which are counted first and numbered apart, so no task holds all jobs."""
    digits = digits if digits is not None else max(0, (jobs.count() // per_bucket).bit_length() + 3) // 4
    mark = jobs.withColumn("_h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("job").cast("string")), 256)).withColumn("_b", F.substring("_h", 1, digits))
    counts = mark.groupBy("_b").agg(F.count("*").alias("_n"))  # a row for each prefix
    base = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("_b", base.alias("_base"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h", "job")) + F.col("_base")
    return mark.join(bases, "_b").withColumn("sample_id", F.concat(F.lit("s"), F.lpad(place.cast("string"), 6, "0"))).drop("_h", "_b", "_base")
