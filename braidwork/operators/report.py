"""Report arithmetic: volatility, savings, grades, counts of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.functions.text import hours


def volatility(files: DataFrame) -> DataFrame:
    """files (path, raw, logic texts). One row: mean of 1 - logic/raw lengths, files, and those at 0.3 or more; blanks are 0."""
    v = F.when(F.coalesce(F.length(F.trim("raw")), F.lit(0)) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.length("logic") / F.length("raw")))
    return files.select(v.alias("v")).agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("volatility"), F.count(F.lit(1)).alias("files"), F.count(F.when(F.col("v") >= 0.3, 1)).alias("volatile"))


def scan_volatility(files: DataFrame) -> DataFrame:
    """volatility of source files (path, content, language): what their comments and white space are of them."""
    from braidwork.functions.code import stripped

    return volatility(files.select("path", F.col("content").alias("raw"), stripped(F.col("content"), F.col("language")).alias("logic")))


def forecast_hours(tasks: Column, volatility_: Column, average_ms: float = 450.0, builds: int = 100) -> Column:
    """Hours that `builds` builds lose: tasks x average x volatility."""
    return tasks * average_ms * volatility_ * builds / 3.6e6


def savings(events: Column, minutes: Column) -> Column:
    """struct(hours to two places, text of the gain)."""
    return F.struct(hours(events, minutes).alias("hours"), F.format_string("%.1f%%", events.cast("double")).alias("gain"))


def grade(efficiency: Column) -> Column:
    return F.when(efficiency >= 90, "A+").when(efficiency >= 80, "A").when(efficiency >= 70, "B").when(efficiency >= 50, "C").otherwise("D")


def optimisation(paths: DataFrame) -> DataFrame:
    """paths (least_ms, actual_ms): efficiency in percent, savings, grade."""
    e = F.when(F.col("actual_ms") > 0, F.col("least_ms") / F.col("actual_ms") * 100).otherwise(100.0)
    return paths.withColumn("efficiency", e).withColumn("saved_ms", F.col("actual_ms") - F.col("least_ms")).withColumn("grade", grade(F.col("efficiency")))


def path_totals(rows: DataFrame, keys: list[str], duration: str) -> DataFrame:
    """The summed duration of each critical path."""
    return rows.groupBy(*keys).agg(F.sum(duration).alias("path_ms"), F.count(F.lit(1)).alias("tasks"))


def finding_counts(findings: DataFrame) -> DataFrame:
    """(severity, kind, n)."""
    return findings.groupBy(F.coalesce("severity", F.lit("warning")).alias("severity"), F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def repository_grade(init_ok: Column, tasks: Column, functional: Column) -> Column:
    return F.when(~init_ok | (tasks == 0), "RED").when(functional == tasks, "GREEN").otherwise("YELLOW")


def is_placeholder(cmd: Column) -> Column:
    """A generated command that only says that none was found."""
    return (F.try_element_at(cmd, F.lit(1)) == "echo") & F.array_join(cmd, " ").contains("No command found for")


def tax_rate(files: DataFrame) -> DataFrame:
    """files (comment_only boolean): share of comment-only changes in percent to one place, and hours at 300 s each."""
    n = F.count(F.when(F.col("comment_only"), 1))
    return files.agg(n.alias("events"), F.count(F.lit(1)).alias("files"), F.round(F.when(F.count(F.lit(1)) > 0, n * 100 / F.count(F.lit(1))).otherwise(0.0), 1).alias("rate"), F.round(n * 300 / 3600, 2).alias("hours"))


def classified_changes(changes: DataFrame, suffixes: tuple[str, ...] = ("go", "ts", "rs", "js")) -> DataFrame:
    """changes (commit, path, before, after) of source files with `reason`: identical, comment/whitespace-only, logic change; null where a side
    is missing or empty. Other files are left out."""
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"//[^\n]*", ""), r"(?s)/\*.*?\*/", ""), r"\s+", " "))
    b, a = F.col("before"), F.col("after")
    reason = F.when((F.coalesce(b, F.lit("")) == "") | (F.coalesce(a, F.lit("")) == ""), None).when(b == a, "identical").when(bare(b) == bare(a), "comment/whitespace-only").otherwise("logic change")
    return changes.where(F.regexp_extract("path", r"\.([^.]*)$", 1).isin(*suffixes)).withColumn("reason", reason)


def history_audit(classified: DataFrame, seconds: int = 300) -> DataFrame:
    """One row: commits, files, logic_changes, events (comment-only changes), their rate in percent, hours at `seconds` each."""
    n, events = F.count(F.lit(1)), F.count(F.when(F.col("reason") == "comment/whitespace-only", 1))
    return classified.agg(F.countDistinct("commit").alias("commits"), n.alias("files"), F.count(F.when(F.col("reason") == "logic change", 1)).alias("logic_changes"), events.alias("events"), F.round(F.when(n > 0, events * 100 / n).otherwise(0.0), 1).alias("rate"), F.round(events * seconds / 3600, 1).alias("hours"))


def dashboard(waves: DataFrame, hits: Column, lookups: Column) -> DataFrame:
    """waves (size, ...): tasks, waves, hit rate in whole percent."""
    return waves.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("tasks"), F.count(F.lit(1)).alias("waves"), F.round(F.when(F.sum(lookups) > 0, F.sum(hits) * 100 / F.sum(lookups)).otherwise(0.0)).cast("bigint").alias("hit_rate"))


def attested(metadata: DataFrame, level: str = "FORMAL") -> DataFrame:
    """How many JSON documents (doc) are valid and of a level."""
    return metadata.agg(F.count(F.when(F.try_parse_json("doc").isNotNull() & (F.get_json_object("doc", "$.level") == level), 1)).alias("n"))


def timing_means(timings: DataFrame) -> DataFrame:
    """timings (kind, ms, bytes): mean, overhead over the fastest kind's mean, throughput in MB/s."""
    m = timings.groupBy("kind").agg(F.avg("ms").alias("mean_ms"), F.sum("bytes").alias("bytes"), F.sum("ms").alias("ms"))
    least = m.agg(F.min("mean_ms").alias("least"))
    return m.crossJoin(F.broadcast(least)).select("kind", "mean_ms", (F.col("mean_ms") / F.col("least") - 1).alias("overhead"), F.when(F.col("ms") > 0, F.col("bytes") / 1e3 / F.col("ms")).alias("mb_s"))


def function_report(files: DataFrame) -> DataFrame:
    """oversized over the functions of source files (path, content)."""
    from braidwork.functions.code import functions_of

    return oversized(files.select(F.explode(functions_of(F.col("content"))).alias("f")).select("f.*"))


def oversized(functions: DataFrame, lines: int = 32, depth: int = 3, parameters: int = 4) -> DataFrame:
    """functions (lines, depth, parameters): how many exceed each limit, and how many any."""
    n = lambda c, most: F.count(F.when(F.col(c) > most, 1)).alias(f"over_{c}")
    return functions.agg(F.count(F.lit(1)).alias("functions"), n("lines", lines), n("depth", depth), n("parameters", parameters), F.count(F.when((F.col("lines") > lines) | (F.col("depth") > depth) | (F.col("parameters") > parameters), 1)).alias("over_any"))


def build_report(path: DataFrame, waves: DataFrame, actual_ms: float) -> DataFrame:
    """path (place, id, duration_ms), the critical path; waves (wave, task_ids). One row, report: a Markdown text of what a build's
    least duration and its efficiency are, the path, and the waves."""
    from braidwork.functions.text import duration_text

    total = F.coalesce(F.sum("duration_ms"), F.lit(0.0))
    steps = F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("**"), F.col("id").cast("string"), F.lit("** "), duration_text(F.col("duration_ms"))).alias("t"))))
    p = path.agg(total.alias("least_ms"), F.array_join(F.transform(steps, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x.t)), "\n").alias("steps"))
    row = F.struct("wave", F.concat(F.lit("| "), F.col("wave").cast("string"), F.lit(" | "), F.size("task_ids").cast("string"), F.lit(" | "), F.array_join(F.transform("task_ids", lambda t: t.cast("string")), ", "), F.lit(" |")).alias("t"))
    w = waves.agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x.t), "\n").alias("rows"), F.count(F.lit(1)).alias("n"))
    e = F.when(F.lit(actual_ms) > 0, F.col("least_ms") / actual_ms * 100).otherwise(100.0)
    line = lambda name, value: F.concat(F.lit(f"| {name} | "), value, F.lit(" |"))
    head = F.concat_ws("\n", F.lit("| | |"), F.lit("|---|---|"), line("Duration", duration_text(F.lit(float(actual_ms)))), line("Least duration", duration_text(F.col("least_ms"))), line("Efficiency", F.format_string("%.2f%%", e)), line("Could be saved", duration_text(F.greatest(F.lit(float(actual_ms)) - F.col("least_ms"), F.lit(0.0)))), line("Waves", F.col("n").cast("string")), line("Grade", grade(e)))
    text = F.concat_ws("\n\n", F.lit("# Build"), head, F.lit("## Critical path"), F.when(F.col("steps") == "", "None.").otherwise(F.col("steps")), F.lit("## Waves"), F.when(F.col("rows") == "", "None.").otherwise(F.concat(F.lit("| Wave | Tasks | Ids |\n|---|---|---|\n"), "rows")))
    return p.crossJoin(F.broadcast(w)).select(text.alias("report"))  # a row each
