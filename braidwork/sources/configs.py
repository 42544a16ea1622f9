"""Readers of project configurations and lock files, and of other tools' configurations as task rows."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXTS = T.ArrayType(T.StringType())
_LISTS = ("cmd", "dependencies", "deps", "inputs", "reads", "outputs", "writes", "claims", "needsEnv", "envReads", "providesEnv", "envWrites", "secrets")
_WHEN = T.StructType([T.StructField("platform", _TEXTS), T.StructField("branch", T.StringType())])
TASK = T.StructType(
    [T.StructField(c, _TEXTS) for c in _LISTS]
    + [T.StructField("when", _WHEN), T.StructField("matrix", T.MapType(T.StringType(), _TEXTS)), T.StructField("env", T.MapType(T.StringType(), T.StringType()))]
    + [T.StructField("cwd", T.StringType()), T.StructField("timeout", T.LongType()), T.StructField("cache", T.BooleanType())]
)
CONFIG = T.StructType([T.StructField("name", T.StringType()), T.StructField("tasks", T.MapType(T.StringType(), TASK)), T.StructField("concurrency", T.LongType()), T.StructField("env", T.MapType(T.StringType(), T.StringType()))])
LOCKED = T.StructType([T.StructField("id", T.StringType()), *TASK.fields])
ENVELOPE = T.StructType([T.StructField("version", T.LongType()), T.StructField("_meta", T.StructType([T.StructField("configHash", T.StringType())])), T.StructField("tasks", T.ArrayType(LOCKED))])
#: Names of the model with the older names that stand for them.
ALIASES = {"dependencies": "deps", "inputs": "reads", "outputs": "writes", "needsEnv": "envReads", "providesEnv": "envWrites"}


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


_PLAIN = [f.name for f in TASK.fields if f.name not in ALIASES and f.name not in ALIASES.values()]


def _rows(task: Column, id_: Column, extra: list[Column]) -> list[Column]:
    return [*extra, id_.alias("id"), *[task[c].alias(c) for c in _PLAIN], *[F.coalesce(task[new], task[old]).alias(new) for new, old in ALIASES.items()]]


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """One row a task of each JSON configuration: file, project, id and the model's columns."""
    parsed = texts(spark, path).select("path", F.from_json("value", CONFIG).alias("c"))
    return parsed.select("path", F.col("c.name").alias("project"), F.explode("c.tasks").alias("id", "task")).select(*_rows(F.col("task"), F.col("id"), [F.col("path"), F.col("project")]))


def config_violations(spark: SparkSession, path: str) -> DataFrame:
    """Files (path, rule) that aren't configurations: no JSON object, or no tasks."""
    parsed = texts(spark, path).select("path", F.try_parse_json("value").isNull().alias("broken"), F.from_json("value", CONFIG).alias("c"))
    return parsed.select("path", F.when(F.col("broken"), "not-json").when(F.coalesce(F.size("c.tasks"), F.lit(0)) < 1, "no-tasks").alias("rule")).where(F.col("rule").isNotNull())


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """(path, version, index, text, task, rule) of lock files' entries: rule says what makes one invalid, null if nothing does."""
    parsed = texts(spark, path).select("path", F.ltrim("value").startswith("[").alias("v1"), "value")
    tasks = F.when(F.col("v1"), F.from_json("value", "array<string>")).otherwise(F.from_json("value", "tasks array<string>")["tasks"])
    one = parsed.select("path", F.when(F.col("v1"), 1).otherwise(2).alias("version"), F.posexplode(tasks).alias("index", "text"))
    cmd = F.from_json(F.get_json_object("text", "$.cmd"), "array<variant>")
    words = F.get_json_object("text", "$.cmd").startswith("[") & (F.size(cmd) > 0) & ~F.exists(cmd, lambda c: F.coalesce(F.schema_of_variant(c), F.lit("VOID")) != "STRING")
    task = F.from_json("text", LOCKED)
    rule = F.when(F.coalesce(F.trim(task["id"]), F.lit("")) == "", "no-id").when(~F.coalesce(words, F.lit(False)), "bad-cmd")
    return one.select("path", "version", "index", "text", task.alias("task"), rule.alias("rule"))


def lock_violations(spark: SparkSession, path: str) -> DataFrame:
    """(path, index, rule) of entries that no lock may hold: `no-id`, or `bad-cmd`, a command that is no list of one text or more."""
    return _entries(spark, path).where(F.col("rule").isNotNull()).select("path", "index", "rule")


def read_lock(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """One row a task of each lock file, bare arrays (version 1) and envelopes alike. The older names win where an entry has both, lists and maps that
    are absent are empty, the timeout is 300000 and the cache true by default.

    strict: an entry without an id or a command fails the query with its index; else such entries are left out (see lock_violations).
    """
    found = _entries(spark, path)
    if strict:
        said = F.concat(F.lit("lock file "), "path", F.lit(": entry "), F.col("index").cast("string"), F.lit(": "), "rule")
        found = found.where(F.when(F.col("rule").isNotNull(), F.raise_error(said).cast("boolean")).otherwise(F.lit(True)))
    one = found.where(F.col("rule").isNull())
    task, none = F.col("task"), F.expr("cast(array() as array<string>)")
    defaults = {"timeout": F.lit(300_000).cast("bigint"), "cache": F.lit(True), "env": F.expr("cast(map() as map<string,string>)"), "claims": none, "secrets": none}
    plain = [(F.coalesce(task[c], defaults[c]) if c in defaults else task[c]).alias(c) for c in _PLAIN]
    return one.select("path", "version", F.trim(task["id"]).alias("id"), *plain, *[F.coalesce(task[old], task[new], none).alias(new) for new, old in ALIASES.items()])


def lock_summary(locks: DataFrame) -> DataFrame:
    """(path, tasks, placeholders, functional) of each lock file."""
    from braidwork.operators.report import is_placeholder

    held = is_placeholder(F.col("cmd"))
    return locks.groupBy("path").agg(F.count(F.lit(1)).alias("tasks"), F.count(F.when(held, 1)).alias("placeholders"), F.count(F.when(~held, 1)).alias("functional"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, seq, duration_ms, cache_misses, total_runs) of JSON histories, one row a kept duration."""
    history = T.MapType(T.StringType(), T.StructType.fromDDL("durations array<double>, cacheMisses bigint, totalRuns bigint"))
    one = texts(spark, path).select(F.explode(F.from_json("value", history)).alias("task_id", "h"))
    return one.select("task_id", "h.*").select("task_id", F.posexplode("durations").alias("seq", "duration_ms"), F.col("cacheMisses").alias("cache_misses"), F.col("totalRuns").alias("total_runs"))


def pipeline_tasks(spark: SparkSession, path: str, field: str) -> DataFrame:
    """(script, on): a monorepo tool's JSON pipeline, {field: {script: {dependsOn: [...]}}}."""
    kind = T.StructType([T.StructField(field, T.MapType(T.StringType(), T.StructType.fromDDL("dependsOn array<string>, outputs array<string>")))])
    one = texts(spark, path).select(F.explode(F.from_json("value", kind)[field]).alias("script", "s"))
    return one.select("script", F.explode_outer(F.col("s.dependsOn")).alias("on"), F.col("s.outputs").alias("outputs"))


def target_dependencies(entry: Column) -> Column:
    """A target's dependency as a plain name: JSON text or an object's target, without ^; null if malformed or empty."""
    parsed = F.try_parse_json(entry)
    name = F.when(parsed.isNotNull() & entry.startswith("{"), F.get_json_object(entry, "$.target")).when(parsed.isNull() | entry.startswith('"'), F.regexp_replace(entry, '^"|"$', ""))
    return F.nullif(F.trim(F.regexp_replace(name, r"^\^", "")), F.lit(""))


def target_path(entry: Column) -> Column:
    """A target's input or output as a path: JSON text, or an object's fileset, glob, root, input or output without the project
    placeholder; null for what names no file."""
    named = F.coalesce(*[F.get_json_object(entry, f"$.{c}") for c in ("fileset", "glob", "root", "input", "output")])
    return F.when(entry.startswith("{"), F.regexp_replace(named, r"\{projectRoot\}/?", "")).when(F.try_parse_json(entry).isNull() | entry.startswith('"'), F.nullif(F.regexp_replace(entry, '^"|"$', ""), F.lit("")))


def turbo_tasks(spark: SparkSession, path: str) -> DataFrame:
    """(path, id, cmd, deps, reads, writes) of a monorepo tool's JSON pipelines, also with comments: `tasks` if there are any, else the older `pipeline`.

    Comments go only if a file isn't JSON as it stands, and line comments only where they fill a line, so that texts with // in them stay.
    """
    kept = F.when(F.try_parse_json("value").isNotNull(), F.col("value")).otherwise(F.regexp_replace(F.regexp_replace("value", r"/\*[\s\S]*?\*/", ""), r"(?m)^\s*//.*$", ""))
    entry = T.MapType(T.StringType(), T.StructType.fromDDL("dependsOn string, inputs string, outputs string"))
    kind = T.StructType([T.StructField("tasks", entry), T.StructField("pipeline", entry)])
    one = texts(spark, path).select("path", F.from_json(kept, kind).alias("c")).select("path", F.explode(F.coalesce("c.tasks", "c.pipeline")).alias("id", "t"))
    none = F.expr("cast(array() as array<string>)")
    listed = lambda c, f: F.array_compact(F.transform(F.coalesce(F.when(F.col(f"t.{c}").startswith("["), F.from_json(F.col(f"t.{c}"), "array<string>")), none), f))
    return one.select("path", "id", F.array(F.lit("npm"), F.lit("run"), "id").alias("cmd"), F.array_distinct(listed("dependsOn", target_dependencies)).alias("deps"), listed("inputs", target_path).alias("reads"), listed("outputs", target_path).alias("writes"))


def target_tasks(spark: SparkSession, path: str) -> DataFrame:
    """(path, id, cmd, deps, reads, writes) of configurations with targetDefaults."""
    kind = T.StructType.fromDDL("targetDefaults map<string, struct<dependsOn: array<string>, inputs: array<string>, outputs: array<string>>>")
    one = texts(spark, path).select("path", F.explode(F.from_json("value", kind)["targetDefaults"]).alias("id", "t"))
    listed = lambda c, f: F.array_compact(F.transform(F.coalesce(F.col(f"t.{c}"), F.expr("cast(array() as array<string>)")), f))
    return one.select("path", "id", F.array(F.lit("npx"), F.lit("nx"), F.lit("run"), "id").alias("cmd"), F.array_distinct(listed("dependsOn", target_dependencies)).alias("deps"), listed("inputs", target_path).alias("reads"), listed("outputs", target_path).alias("writes"))


def lerna_tasks(files: DataFrame) -> DataFrame:
    """files (root, name). (root, id, cmd, deps): the two tasks of every root with a lerna.json."""
    one = lambda x, deps: F.struct(F.lit(x).alias("id"), F.array(*[F.lit(w) for w in ("npx", "lerna", "run", x)]).alias("cmd"), F.array(*[F.lit(w) for w in deps]).cast("array<string>").alias("deps"))
    return files.where("name = 'lerna.json'").select("root").distinct().select("root", F.explode(F.array(one("build", ()), one("test", ("build",)))).alias("t")).select("root", "t.*")


def workspace_packages(files: DataFrame) -> DataFrame:
    """files (root, name, value). (root, directory, package, scripts, depends): the packages that the globs of a root's package.json
    name, or those of its pnpm-workspace.yaml if it names none. A star stands for one level, two for any."""
    kind = T.StructType.fromDDL("name string, workspaces array<string>, scripts map<string,string>, dependencies map<string,string>, devDependencies map<string,string>")
    manifest = files.where(F.regexp_extract("name", "[^/]*$", 0) == "package.json").select("root", F.regexp_replace("name", "/?package\\.json$", "").alias("directory"), F.from_json("value", kind).alias("p"))
    own = manifest.where("directory = ''").select("root", F.col("p.workspaces").alias("globs"))

    def globs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [simple_yaml(v) for v in part["value"]]
            yield pd.DataFrame({"root": part["root"], "yaml": [list(f["packages"]) if isinstance(f, dict) and isinstance(f.get("packages"), list) else [] for f in found]})

    pnpm = files.where("name = 'pnpm-workspace.yaml'").select("root", "value").mapInPandas(globs, f"root {dict(files.dtypes)['root']}, yaml array<string>")
    both = own.join(pnpm, "root", "left").select("root", F.explode(F.when(F.coalesce(F.size("globs"), F.lit(0)) > 0, F.col("globs")).otherwise(F.col("yaml"))).alias("glob"))
    level = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("glob", r"^\./|/$", ""), r"([.+()\[\]{}^$|])", r"\\$1"), r"\*\*", "\u0001"), r"\*", "[^/]*"), "\u0001", ".*")
    # A root's globs are few; its packages meet them by the root.
    met = manifest.join(both.select("root", F.concat(F.lit("^"), level, F.lit("$")).alias("glob")), "root").where(F.regexp_like("directory", F.col("glob")))
    depends = F.array_distinct(F.concat(*[F.coalesce(F.map_keys(F.col(f"p.{c}")), F.expr("cast(array() as array<string>)")) for c in ("dependencies", "devDependencies")]))
    return met.select("root", F.when(F.col("directory") == "", ".").otherwise(F.col("directory")).alias("directory"), F.col("p.name").alias("package"), F.map_keys("p.scripts").alias("scripts"), depends.alias("depends")).distinct()


def package_scripts(spark: SparkSession, path: str) -> DataFrame:
    """(path, package, script, command) of package.json files."""
    kind = T.StructType.fromDDL("name string, scripts map<string,string>")
    parsed = texts(spark, path).select("path", F.from_json("value", kind).alias("p"))
    return parsed.select("path", F.col("p.name").alias("package"), F.explode("p.scripts").alias("script", "command"))


def package_dependencies(spark: SparkSession, path: str) -> DataFrame:
    """(package, name) of all kinds of dependencies of package.json files."""
    maps = "map<string,string>"
    kind = T.StructType.fromDDL(f"name string, dependencies {maps}, devDependencies {maps}, peerDependencies {maps}")
    p = texts(spark, path).select(F.from_json("value", kind).alias("p"))
    keys = [F.coalesce(F.map_keys(F.col(f"p.{c}")), F.expr("cast(array() as array<string>)")) for c in ("dependencies", "devDependencies", "peerDependencies")]
    return p.select(F.col("p.name").alias("package"), F.explode(F.array_distinct(F.concat(*keys))).alias("name"))


def marked_tasks(files: DataFrame) -> DataFrame:
    """files (root, name: path below it). (root, kind, id, cmd, deps): canned tasks by what a root holds.

    Cargo.toml: build, test and lint, bench with files of benches/ or *_bench.rs outside target/. go.mod: build, test with
    *_test.go outside vendor/. requirements.txt or pyproject.toml: install, test with Python files in tests/ or named test_
    outside venv/ and .tox/; poetry runs them if there is a pyproject.toml.
    """
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    n = F.col("name")
    bench = n.endswith(".rs") & ~n.contains("target/") & (n.contains("benches/") | n.endswith("_bench.rs"))
    tested = n.endswith(".py") & ~n.contains("venv/") & ~n.contains(".tox/") & (n.startswith("tests/") | n.contains("test_"))
    marks = {"cargo": n == "Cargo.toml", "go": n == "go.mod", "poetry": n == "pyproject.toml", "pip": n == "requirements.txt", "bench": bench, "go_test": n.endswith("_test.go") & ~n.contains("vendor/"), "py_test": tested}
    roots = files.groupBy("root").agg(*[any_(c).alias(k) for k, c in marks.items()])
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    task = lambda when, kind, id_, cmd, *deps: F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(id_).alias("id"), cmd.alias("cmd"), words(*deps).cast("array<string>").alias("deps")))
    has, py = F.col, F.col("poetry") | F.col("pip")
    tasks = F.array_compact(F.array(
        task(has("cargo"), "cargo", "build", words("cargo", "build")), task(has("cargo"), "cargo", "test", words("cargo", "test"), "build"), task(has("cargo") & has("bench"), "cargo", "bench", words("cargo", "bench"), "build"),
        task(has("cargo"), "cargo", "lint", words("cargo", "clippy", "--", "-D", "warnings")), task(has("go"), "go", "build", words("go", "build", "./...")), task(has("go") & has("go_test"), "go", "test", words("go", "test", "./..."), "build"),
        task(py, "python", "install", F.when(has("poetry"), words("poetry", "install")).otherwise(words("pip", "install", "-r", "requirements.txt"))),
        task(py & has("py_test"), "python", "test", F.when(has("poetry"), words("poetry", "run", "pytest")).otherwise(words("pytest")), "install"),
    ))
    return roots.select("root", F.explode(tasks).alias("t")).select("root", "t.*")


def cargo_members(manifest: Column) -> Column:
    """The members of a one-line `members = [...]`."""
    return F.filter(F.split(F.regexp_replace(F.regexp_extract(manifest, r"members\s*=\s*\[([^\]\n]*)\]", 1), r'[\s"\']', ""), ","), lambda m: m != "")


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/"}
_FLOW = re.compile(r"""\s*(?:(?P<mark>[][{},])|"(?P<double>(?:[^"\\]|\\.)*)"|'(?P<single>(?:[^']|'')*)'|(?P<plain>(?:[^][{},:#]|:(?!\s|$)|(?<!\s)\#)+))\s*(?P<colon>:(?=\s|$|[][{},"']))?""", re.S)
_KEY = re.compile(r"""(?:"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'|([^\s"'\[{#&*!|>%@`-][^#:]*?(?:(?:[#:](?=\S))[^#:]*?)*|-(?=\S)[^:]*?))\s*:(?:\s+|$)""")
_BLOCK = re.compile(r"([|>])([+-]?)(\d?)([+-]?)\s*(?:#.*)?$")


def _text_of(double: str | None, single: str | None) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), double, flags=re.S) if double is not None else single.replace("''", "'")


def _plain(s: str) -> object:
    return {"true": True, "false": False, "null": None, "~": None, "": None}.get(s, s)


def _flow(s: str, at: int) -> tuple[object, int]:
    """The value of flow style that begins at a place, and the place behind it."""
    m = _FLOW.match(s, at)
    if not m:
        return None, len(s)
    if m["mark"] is None:
        return _plain(m["plain"].strip()) if m["plain"] is not None else _text_of(m["double"], m["single"]), m.end()
    if m["mark"] not in "[{":
        return None, at
    close, out, at = {"[": "]", "{": "}"}[m["mark"]], [], m.end()
    while at < len(s):
        mark = _FLOW.match(s, at)
        if mark and mark["mark"] in ("]", "}", ","):
            at = mark.end()
            if mark["mark"] == close:
                break
            continue
        key = mark["colon"] if mark else None
        value, at = _flow(s, at)
        if key:
            inner, at = _flow(s, at)
            out.append((value, inner))
        elif mark is None:
            break
        else:
            out.append((value, None) if close == "}" else value)
    return ({str(k): v for k, v in out} if close == "}" else [{str(x[0]): x[1]} if isinstance(x, tuple) else x for x in out]), at


def _depth(s: str) -> int:
    """Brackets and braces that are open at the end of a text, quoted ones left aside."""
    bare = re.sub(r"""\"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'""", "", s)
    return sum(bare.count(c) for c in "[{") - sum(bare.count(c) for c in "]}")


def _scalar(s: str) -> object:
    """A value that stands on its line: quoted, of flow style, or plain up to a comment."""
    s = s.strip()
    if s[:1] in ("[", "{"):
        return _flow(s, 0)[0]
    if s[:1] in ("'", '"') and (m := re.match(r"""(?:"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)')\s*(?:\s#.*)?$""", s, re.S)):
        return _text_of(m[1], m[2])
    return _plain(re.sub(r"(?:^|\s+)#.*$", "", s).strip())


def simple_yaml(text: str) -> object:
    """Block mappings and lists, flow lists and maps, quoted, plain and block scalars, comments: what pipeline files use. Numbers stay texts.

    Block scalars keep their lines as they are, blank ones, marks of comments and further indentation included. Anchors, tags, several
    documents and plain scalars over several lines aren't read.
    """
    lines = text.replace("\r\n", "\n").removesuffix("\n").split("\n")
    indent = lambda i: len(lines[i]) - len(lines[i].lstrip(" "))
    body = lambda i: lines[i].strip()

    def skip(i: int) -> int:
        while i < len(lines) and (not body(i) or body(i)[0] == "#" or body(i) in ("---", "...")):
            i += 1
        return i

    def block_scalar(i: int, above: int, m: re.Match) -> tuple[str, int]:
        begin = i
        while i < len(lines) and (not lines[i].strip() or indent(i) > above):
            i += 1
        own = lines[begin:i]
        width = above + int(m[3]) if m[3] else min((len(x) - len(x.lstrip(" ")) for x in own if x.strip()), default=0)
        own = [x[width:] for x in own]
        trailing = 0
        while own and not own[-1].strip():
            own.pop()
            trailing += 1
        if m[1] == "|":
            made = "\n".join(own)
        else:
            made = ""
            for k, x in enumerate(own):
                joined = k and x and own[k - 1] and not x.startswith(" ") and not own[k - 1].startswith(" ")
                made += (" " if joined else "\n" if k and (x and not own[k - 1] or x.startswith(" ") or not x and k > 1 and not own[k - 1] or own[k - 1].startswith(" ")) else "") + x
        chomp = m[2] or m[4]
        return made + ("" if chomp == "-" or not own else "\n" * (trailing + 1) if chomp == "+" else "\n"), i

    def value(i: int, above: int, rest: str, in_list: bool) -> tuple[object, int]:
        """What stands behind a key or a dash: on the line, as a block scalar, or below."""
        if m := _BLOCK.match(rest):
            return block_scalar(i + 1, above, m)
        if rest[:1] in ("[", "{"):
            while _depth(rest) > 0 and i + 1 < len(lines):  # over several lines
                i += 1
                rest += " " + re.sub(r"(?:^|\s+)#.*$", "", body(i))
        if _scalar(rest) is not None or re.sub(r"(?:^|\s+)#.*$", "", rest).strip():
            return _scalar(rest), i + 1
        below = skip(i + 1)
        if below < len(lines) and (indent(below) > above or not in_list and indent(below) == above and re.match(r"-(\s|$)", body(below))):
            return block(below, indent(below))
        return None, i + 1

    def block(i: int, at: int) -> tuple[object, int]:
        if re.match(r"-(\s|$)", body(i)):
            out: list = []
            while (i := skip(i)) < len(lines) and indent(i) == at and (m := re.match(r"-(\s+|$)", body(i))):
                rest = body(i)[m.end() :]
                if _KEY.match(rest) or re.match(r"-(\s|$)", rest):
                    lines[i] = " " * (at + m.end()) + rest
                    made, i = block(i, at + m.end())
                else:
                    made, i = value(i, at, rest, True)
                out.append(made)
            return out, i
        if not (m := _KEY.match(body(i))):
            return _scalar(body(i)), i + 1
        made = {}
        while (i := skip(i)) < len(lines) and indent(i) == at and (m := _KEY.match(body(i))):
            key = m[3] if m[3] is not None else _text_of(m[1], m[2])
            made[key], i = value(i, at, body(i)[m.end() :], False)
        return made, i

    first = skip(0)
    return block(first, indent(first))[0] if first < len(lines) else None


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """(path, json): YAML files as JSON text, for from_json and get_json_object."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"path": part["path"], "json": [json.dumps(simple_yaml(v)) for v in part["value"]]})

    return texts(spark, path).mapInPandas(run, "path string, json string")


_VALUE = r"\$\{\{\s*values\.(\w[\w.-]*)\s*\}\}"


def step_warnings(spark: SparkSession, path: str, prefix: str = "VALUE") -> DataFrame:
    """(path, place, name, variable): placeholders of a YAML pipeline's env values and commands, each name once a file, where it stands first; a task's env
    comes before its command. A name that begins one warned of before counts as the same."""
    kind = T.StructType([T.StructField("tasks", T.ArrayType(T.StructType.fromDDL("run string, env map<string,string>")))])
    one = read_yaml(spark, path).select("path", F.from_json("json", kind)["tasks"].alias("tasks"))
    names = lambda text, place: F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_VALUE), F.lit(1)), lambda n: F.struct(F.lit(place).alias("place"), n.alias("name")))
    each = lambda t: F.concat(F.flatten(F.transform(F.coalesce(F.map_values(t["env"]), F.expr("cast(array() as array<string>)")), lambda v: names(v, "env"))), names(t["run"], "command"))
    found = F.flatten(F.transform("tasks", each))
    once = F.aggregate(found, F.expr("cast(array() as array<struct<place:string,name:string>>)"), lambda seen, x: F.when(F.exists(seen, lambda y: y["name"].startswith(x["name"])), seen).otherwise(F.concat(seen, F.array(x))))
    variable = F.concat(F.lit(f"{prefix}_"), F.upper(F.regexp_replace("w.name", "[.-]", "_")))
    return one.select("path", F.explode(once).alias("w")).select("path", "w.place", "w.name", variable.alias("variable"))


def read_step_pipeline(spark: SparkSession, path: str, prefix: str = "VALUE") -> DataFrame:
    """(path, id, cmd, deps, env) of YAML pipelines with tasks of key, run, after, use and env; deps are after and use together
    in their order, placeholders in env values name variables with the prefix, commands stay as they are."""
    from braidwork.functions.text import shell_command, template_variables

    kind = T.StructType([T.StructField("tasks", T.ArrayType(T.StructType.fromDDL("key string, run string, after string, use string, env map<string,string>")))])
    one = read_yaml(spark, path).select("path", F.explode(F.from_json("json", kind)["tasks"]).alias("t"))
    many = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.when(c.isNotNull() & ~c.startswith("["), F.array(c)), F.expr("cast(array() as array<string>)"))
    env = F.transform_values(F.coalesce("t.env", F.expr("cast(map() as map<string,string>)")), lambda _, v: template_variables(v, prefix))
    return one.select("path", F.col("t.key").alias("id"), shell_command(F.coalesce("t.run", F.lit(""))).alias("cmd"), F.array_distinct(F.concat(many(F.col("t.after")), many(F.col("t.use")))).alias("deps"), env.alias("env"))
