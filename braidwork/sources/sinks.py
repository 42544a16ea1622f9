"""Writers: lock files, upserted ledgers, reports, event streams."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.functions.text import sorted_set
from braidwork.operators.hashing import NUL
from braidwork.operators.ledger import upsert
from braidwork.plans.session import cut_lineage


def lock_rows(tasks: DataFrame, version: int = 2) -> DataFrame:
    """One row of JSON: version, hash of the configuration, tasks in code-unit order of id. A lock file is one document
    by its format, so its tasks meet in one row."""
    lists = [c for c, t in tasks.dtypes if t == "array<string>" and c not in ("cmd", "id")]
    each = tasks.withColumns({c: sorted_set(F.col(c)) for c in lists})
    body = F.array_sort(F.collect_list(F.struct("id", *[c for c in each.columns if c != "id"])), lambda a, b: F.when(a.id < b.id, -1).when(a.id > b.id, 1).otherwise(0))
    hashed = F.sha2(F.array_join(F.transform(F.col("tasks"), lambda t: F.to_json(t)), NUL), 256)
    one = each.agg(body.alias("tasks"))
    return one.select(F.to_json(F.struct(F.lit(version).alias("version"), F.struct(hashed.alias("configHash")).alias("_meta"), "tasks")).alias("value"))


def write_lock(tasks: DataFrame, path: str) -> None:
    """A lock document as one text file; Spark's commit protocol makes it appear whole."""
    lock_rows(tasks).coalesce(1).write.mode("overwrite").text(path)


def write_ledger(ledger: DataFrame, incoming: DataFrame, path: str, key: str = "logic_hash", order: str = "timestamp") -> None:
    """The ledger with incoming rows merged by key, at a path that it isn't read from."""
    upsert(ledger, incoming, key, order).write.mode("overwrite").parquet(path)


def clear_ledger(ledger: DataFrame, path: str) -> None:
    """An empty ledger of the same columns."""
    ledger.limit(0).write.mode("overwrite").parquet(path)


def write_history(history: DataFrame, path: str) -> None:
    """history (task_id, durations, cacheMisses, totalRuns) as JSON lines."""
    history.write.mode("overwrite").json(path)


def dashboard_json(waves: DataFrame) -> DataFrame:
    """waves (wave, task_ids) as one JSON text in which < and > are escaped, fit to stand in a page."""
    text = F.to_json(F.array_sort(F.collect_list(F.struct("wave", "task_ids"))))
    return waves.agg(F.replace(F.replace(text, F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e")).alias("json"))


def _chunks(rows: Iterable, most: int) -> Iterator[list[dict]]:
    rows = iter(rows)
    while some := [r.asDict(recursive=True) for r in islice(rows, most)]:
        yield some


def span_elements(spans: DataFrame, service: str = "braidwork") -> DataFrame:
    """spans (name, start_ms, duration_ms, attributes map<string,string>) as (element): JSON of one resource's span each, as trace collectors take them in a list.

    Ids are made from what a span says, so one that is sent again has the same; times are in nanoseconds; attributes are in the order of their names.
    """
    start, end = F.col("start_ms").cast("bigint"), F.col("start_ms").cast("bigint") + F.col("duration_ms").cast("bigint")
    own = F.coalesce("attributes", F.expr("cast(map() as map<string,string>)"))
    pairs = F.transform(F.array_sort(F.map_entries(own)), lambda e: F.struct(e.key.alias("key"), F.struct(F.coalesce(e.value, F.lit("null")).alias("stringValue")).alias("value")))
    trace = F.md5(F.concat_ws("\0", "name", start.cast("string"), end.cast("string"), F.to_json(F.map_entries(own))).cast("binary"))
    span = F.struct(trace.alias("traceId"), F.left(F.md5(trace.cast("binary")), F.lit(16)).alias("spanId"), F.col("name"), F.lit(1).alias("kind"), (start * 1_000_000).alias("startTimeUnixNano"), (end * 1_000_000).alias("endTimeUnixNano"), pairs.alias("attributes"))
    resource = F.struct(F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.lit(service).alias("stringValue")).alias("value"))).alias("attributes"))
    return spans.select(F.to_json(F.struct(resource.alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("element"))


def export_spans(spans: DataFrame, url: str, service: str = "braidwork", timeout: float = 5.0, most: int = 1000) -> None:
    """POST spans (see span_elements) to a collector, at most so many a request; failures don't fail the job."""

    def send(rows) -> None:
        for some in _chunks(rows, most):
            body = '{"resourceSpans":[' + ",".join(r["element"] for r in some) + "]}"
            try:
                urllib.request.urlopen(urllib.request.Request(url, body.encode(), {"Content-Type": "application/json"}), timeout=timeout)
            except OSError:
                pass

    span_elements(spans, service).foreachPartition(send)


def broadcast_events(stream: DataFrame, writers: list[Callable[[list[dict]], None]], checkpoint: str, most: int = 1000):
    """Send each micro-batch to every writer on the driver, at most so many events a call; a writer that fails is dropped, the others go on.

    For few listeners of small streams, by design; what must scale or arrive once goes through objects.deliver.
    """
    live = list(writers)

    def batch(df: DataFrame, _: int) -> None:
        for some in _chunks(df.toLocalIterator(), most):
            for w in list(live):
                try:
                    w(some)
                except Exception:  # noqa: BLE001  any failure of a listener is its own
                    live.remove(w)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def config_rows(tasks: DataFrame, project: str | None = None) -> DataFrame:
    """tasks (id, cmd, dependencies, inputs, outputs, claims, ..., cache, timeout) back as one JSON configuration.

    The inverse of reading one: fs claims go, since inputs and outputs imply them; empty lists and maps, a cache that is true
    and the default timeout are left out. Ids and edges must be valid (config_with_report makes them so).
    """
    unset = lambda c: F.when(F.size(c) > 0, F.col(c))
    lists = [c for c, t in tasks.dtypes if t == "array<string>" and c not in ("cmd", "claims")]
    fields = [F.col("cmd"), *[unset(c).alias(c) for c in lists]]
    if "claims" in tasks.columns:
        kept = F.filter("claims", lambda c: ~c.startswith("fs:"))
        fields.append(F.when(F.size(kept) > 0, kept).alias("claims"))
    if "cache" in tasks.columns:
        fields.append(F.when(~F.col("cache"), F.col("cache")).alias("cache"))
    if "timeout" in tasks.columns:
        fields.append(F.when(F.col("timeout") != 300_000, F.col("timeout")).alias("timeout"))
    if "env" in tasks.columns:
        fields.append(unset(F.col("env")).alias("env"))
    if "cwd" in tasks.columns:
        fields.append(F.nullif("cwd", F.lit("")).alias("cwd"))
    body = F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", F.struct(*fields).alias("task"))), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)))
    name = [F.lit(project).alias("name")] if project else []
    return tasks.agg(F.to_json(F.struct(*name, body.alias("tasks"))).alias("value"))


def config_with_report(tasks: DataFrame, project: str | None = None) -> tuple[DataFrame, DataFrame]:
    """tasks (seq, id, cmd, dependencies, ...) of any ids. (one configuration as in config_rows, what was pruned (id, dependency, reason)).

    Ids become valid and unique in the order of seq, dependencies follow them; of tasks of one id the last counts. Dependencies
    that name no task go, and, in the order of seq and name, those that would close a cycle.
    """
    from braidwork.operators.expand import unique_ids
    from braidwork.operators.graph import _placed, without_cycles

    ids = unique_ids(tasks.select("seq", F.col("id").alias("name")))
    named = tasks.join(ids.select("seq", F.col("id").alias("_new")), "seq")
    last = named.groupBy("id").agg(F.max_by("_new", "seq").alias("_new"), F.max("seq").alias("seq"))
    own = cut_lineage(tasks.join(last, ["id", "seq"]), "named")
    wanted = own.select("seq", F.col("_new").alias("dst"), F.explode("dependencies").alias("dep")).join(last.select(F.col("id").alias("dep"), F.col("_new").alias("_to")), "dep", "left")
    edges = _placed(wanted.select("seq", "dst", F.coalesce("_to", "dep").alias("src")).distinct(), ["seq", "src"], 0).select(F.col("_pos").alias("seq"), "src", "dst")
    kept, dropped = without_cycles(own.select(F.col("_new").alias("id")), edges)
    listed = kept.groupBy(F.col("dst").alias("_new")).agg(F.array_sort(F.collect_list("src")).alias("dependencies"))
    ready = own.drop("dependencies", "id", "seq").join(listed, "_new", "left").withColumn("dependencies", F.coalesce("dependencies", F.expr("cast(array() as array<string>)"))).withColumnRenamed("_new", "id")
    known = own.select(F.col("_new").alias("src"), F.lit(True).alias("_known"))
    report = dropped.join(known, "src", "left").select(F.col("dst").alias("id"), F.col("src").alias("dependency"), F.when(F.col("_known"), "would create a dependency cycle").otherwise("no such task").alias("reason"))
    return config_rows(ready, project), report


def annotations(findings: DataFrame, file: str | None = None) -> DataFrame:
    """findings (severity, kind, task_a, task_b, resource) as lines of a build log that its viewer shows at a file."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    of = F.replace(F.replace(escaped(F.lit(file)), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C")) if file else None
    message = F.concat("kind", F.lit(" of "), "task_a", F.lit(" and "), "task_b", F.lit(": "), "resource")
    return findings.select(F.concat(F.lit("::"), "severity", *([F.lit(" file="), of] if file else []), F.lit("::"), escaped(message)).alias("line"))


def annotation_outputs(findings: DataFrame) -> DataFrame:
    """One row: found, verified, and how many findings there are in all and of each kind."""
    of = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    n = F.count(F.lit(1))
    return findings.agg(F.lit(True).alias("found"), (n == 0).alias("verified"), n.alias("findings"), of("collision").alias("collisions"), of("shadow").alias("shadows"), of("implicit-dependency").alias("implicit"))


def step_pipeline(tasks: DataFrame) -> DataFrame:
    """tasks (id, cmd, deps) as one YAML pipeline of steps with key, run and after; a shell's -c stands as its command. Inverse of
    configs.read_step_pipeline."""
    run = F.when((F.size("cmd") == 3) & (F.col("cmd")[0] == "sh") & (F.col("cmd")[1] == "-c"), F.col("cmd")[2]).otherwise(F.array_join("cmd", " "))
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    quoted = lambda c: F.when(c.contains("\n"), F.concat(F.lit('"'), escaped(c), F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'")))
    after = F.when(F.size("deps") > 0, F.concat(F.lit("    after: ["), F.array_join(F.transform("deps", quoted), ", "), F.lit("]\n"))).otherwise("")
    step = F.concat(F.lit("  - key: "), quoted(F.col("id")), F.lit("\n    run: "), quoted(run), F.lit("\n"), after)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", step.alias("step")))), lambda x: x.step), "")
    return tasks.agg(F.concat(F.lit("version: '1.0'\ntasks:\n"), listed).alias("value"))


def pushed(objects: DataFrame, key: str | None) -> DataFrame:
    """objects (hash, metadata JSON, payload). (hash, content): 4-byte little-endian length, metadata with the hash and a signature of it all
    (null without a key), payload: what files.frame_metadata reads. Names that may not stand in a store's path fail the query."""
    from braidwork.functions.code import canonical_json, hmac_sha256
    from braidwork.functions.text import is_hash_name

    named = objects.withColumn("hash", F.when(is_hash_name(F.col("hash")), F.col("hash")).otherwise(F.raise_error(F.concat(F.lit("no name for an object: "), "hash"))))
    whole = F.to_json(F.map_concat(F.from_json("metadata", "map<string,string>"), F.create_map(F.lit("hash"), "hash")))
    based = named.withColumn("_m", canonical_json(whole))
    signature = hmac_sha256(F.lit(key), F.concat_ws("\0", "hash", F.sha2("payload", 256), "_m")) if key else F.lit(None).cast("string")
    signed = based.withColumn("_m", F.concat(F.expr("substring(_m, 1, length(_m) - 1)"), F.lit(',"signature":'), F.coalesce(F.concat(F.lit('"'), signature, F.lit('"')), F.lit("null")), F.lit("}")))
    n = F.octet_length("_m")
    byte = lambda k: F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(F.lit(255))), 2, "0")
    return signed.select("hash", F.concat(F.unhex(F.concat(*[byte(k) for k in range(4)])), F.col("_m").cast("binary"), "payload").alias("content"))


def promoted(objects: DataFrame, key: str | None) -> DataFrame:
    """objects (hash, content) as pushed. (hash, payload, trusted): the payload without its header; trusted if the signature is this key's, or without a key."""
    from braidwork.functions.code import hmac_sha256
    from braidwork.sources.files import frame_metadata

    read = frame_metadata(objects.select(F.col("hash").alias("path"), "content")).withColumnRenamed("path", "hash")
    base = F.concat(F.regexp_replace("metadata", ',"signature":(null|"[0-9a-f]*")\\}$', ""), F.lit("}"))
    good = F.coalesce(F.get_json_object("metadata", "$.signature") == hmac_sha256(F.lit(key), F.concat_ws("\0", "hash", F.sha2("payload", 256), base)), F.lit(False)) if key else F.lit(True)
    return read.select("hash", "payload", (F.col("metadata").isNotNull() & good).alias("trusted"))
