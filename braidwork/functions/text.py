"""Scalar expressions over strings, paths, numbers and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions whose source has a comment syntax that the stripper knows.
LANGUAGES = {
    "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cxx": "cpp", "cs": "csharp", "go": "go", "java": "java", "js": "javascript", "jsx": "javascript",
    "mjs": "javascript", "kt": "kotlin", "kts": "kotlin", "php": "php", "py": "python", "rb": "ruby", "rs": "rust", "swift": "swift", "ts": "typescript", "tsx": "typescript",
}


def normalise_fs_path(path: Column) -> Column:
    """Without a leading fs:, with forward slashes, without one leading ./ and any trailing slashes."""
    return F.regexp_replace(F.regexp_replace(F.translate(F.regexp_replace(path, "^fs:", ""), "\\", "/"), "^\\./", ""), "/+$", "")


def is_safe_path(path: Column) -> Column:
    """Relative and without a `..` segment between slashes; back slashes only count after that, as separators."""
    return ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")


def sanitised_path(path: Column) -> Column:
    """The path with forward slashes; an unsafe one fails the query."""
    return F.when(is_safe_path(path), F.translate(path, "\\", "/")).otherwise(F.raise_error(F.concat(F.lit("unsafe path: "), path)))


def folded_path(path: Column) -> Column:
    """The path with `.` and `..` segments resolved and empty ones dropped; `..` above the start stays."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    step = lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != ".."), F.slice(acc, 1, F.size(acc) - 1)).when((p == "..") & path.startswith("/"), acc).otherwise(F.concat(acc, F.array(p)))
    folded = F.array_join(F.aggregate(parts, F.expr("cast(array() as array<string>)"), step), "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), folded)).otherwise(F.when(folded == "", ".").otherwise(folded))


def dirname(path: Column) -> Column:
    """All before the last slash; without one '.'; the root's is '/'."""
    up = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(~path.contains("/"), ".").when(up == "", "/").otherwise(up)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)/*$", 1)


def extension(path: Column) -> Column:
    """The suffix of the last segment in lower case without its dot; names that begin with their only dot have none."""
    return F.lower(F.regexp_extract(basename(path), "^.+\\.([^.]*)$", 1))


def language(path: Column) -> Column:
    """The language of a source file by its extension, null if unknown."""
    pairs = [x for k, v in sorted(LANGUAGES.items()) for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def protocol(claim: Column) -> Column:
    """The protocol of `proto:path`, lower case; fs without one."""
    found = F.lower(F.regexp_extract(claim, "(?i)^([a-z0-9]{2,}):(.*)$", 1))
    return F.when(found == "", "fs").otherwise(found)


def resource(claim: Column) -> Column:
    """What follows the protocol."""
    return F.when(F.regexp_extract(claim, "(?i)^([a-z0-9]{2,}):(.*)$", 1) == "", claim).otherwise(F.regexp_extract(claim, "(?i)^([a-z0-9]{2,}):(.*)$", 2))


def caller_name(caller: Column) -> Column:
    """`name-v1.2` as name, split at the last `-v`; unknown for null and empty."""
    return F.when(F.coalesce(caller, F.lit("")) == "", "unknown").otherwise(F.regexp_replace(caller, "(?s)-v(?!.*-v).*$", ""))


def caller_version(caller: Column) -> Column:
    """`name-v1.2` as v1.2; unknown without a version."""
    found = F.regexp_extract(F.coalesce(caller, F.lit("")), "(?s)-(v(?!.*-v).*)$", 1)
    return F.when(found == "", "unknown").otherwise(found)


def is_hash_name(name: Column) -> Column:
    """A name that may stand in a store's path."""
    return name.rlike("^[a-zA-Z0-9_.-]+$") & ~name.contains("..")


def slug(name: Column) -> Column:
    """An identifier: each other character becomes a dash, dashes at the ends go, nothing left is `task`."""
    trimmed = F.regexp_replace(F.regexp_replace(name, "[^a-zA-Z0-9_-]", "-"), "^-+|-+$", "")
    return F.when(trimmed == "", "task").otherwise(trimmed)


def branch_matches(branch: Column, pattern: Column) -> Column:
    """Equality, or a pattern whose * stands for anything; an unknown branch passes."""
    return F.when(branch.isNull() | (branch == ""), True).otherwise((branch == pattern) | F.regexp_like(branch, F.concat(F.lit("^"), F.replace(pattern, F.lit("*"), F.lit(".*")), F.lit("$"))))


def tail(log: Column, size: int = 102_400) -> Column:
    """The last `size` code points."""
    return F.right(log, F.lit(size))


def duration_text(ms: Column) -> Column:
    """Microseconds, milliseconds or seconds, whichever reads best; zero below one microsecond."""
    return F.when(ms < 0.001, "0μs").when(ms < 1, F.format_string("%.0fμs", ms * 1000)).when(ms < 1000, F.format_string("%.1fms", ms)).otherwise(F.format_string("%.2fs", ms / 1000))


def bar(value: Column, top: Column, width: int = 20) -> Column:
    """A bar of `width` places filled in proportion."""
    n = F.least(F.lit(width), F.greatest(F.lit(0), F.round(value * width / top).cast("int")))
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(width) - n))


def template_variables(text: Column, prefix: str) -> Column:
    """`${{ values.name }}` as `${PREFIX_NAME}`: the name in upper case with underscores for its dots and dashes."""
    names = F.regexp_extract_all(text, F.lit(r"\$\{\{\s*values\.(\w[\w.-]*)\s*\}\}"), F.lit(1))
    return F.aggregate(F.array_distinct(names), text, lambda acc, n: F.regexp_replace(acc, F.concat(F.lit(r"\$\{\{\s*values\.\Q"), n, F.lit(r"\E\s*\}\}")), F.concat(F.lit(f"\\${{{prefix}_"), F.upper(F.regexp_replace(n, "[.-]", "_")), F.lit("}"))))


def is_composite(command: Column) -> Column:
    """Whether a command needs a shell: it holds && or || or a pipe or a semicolon."""
    return command.rlike(r"&&|[|;]")


def shell_command(command: Column) -> Column:
    """The argument vector of a command line."""
    return F.when(is_composite(command), F.array(F.lit("sh"), F.lit("-c"), command)).otherwise(F.filter(F.split(command, r"\s+"), lambda w: w != ""))


def sorted_set(items: Column) -> Column:
    """Distinct members in code-unit order, null as empty."""
    return F.array_sort(F.array_distinct(F.coalesce(items, F.expr("cast(array() as array<string>)"))))


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def iso_time(ms: Column) -> Column:
    """Epoch milliseconds as ISO 8601 text in UTC."""
    return F.date_format(F.timestamp_millis(ms.cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def hours(events: Column, minutes: Column) -> Column:
    return F.round(events * minutes / 60, 2)


def octal(text: Column) -> Column:
    """The number that octal digits between spaces and NULs say, as archives have it; null for anything else."""
    digits = F.trim(F.replace(text, F.lit("\0"), F.lit(" ")))
    return F.when(digits.rlike("^[0-7]+$"), F.conv(digits, 8, 10).cast("bigint"))


def base64url(raw: Column) -> Column:
    """Base 64 in the alphabet for addresses, without padding or line breaks."""
    return F.rtrim(F.translate(F.base64(raw), "+/=\r\n", "-_"))
