import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from braidwork.operators import trace
from braidwork.sources import configs, files, sinks
from braidwork.streaming import folds


def test_config_lock_and_violations(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"name": "p", "tasks": {"build": {"cmd": ["tsc"], "inputs": ["src"], "deps": ["x"]}, "test": {"cmd": ["t"]}}}))
    (tmp_path / "bad.json").write_text("{nope")
    (tmp_path / "none.json").write_text("{}")
    got = {r.id: r for r in configs.read_config(spark, f"{tmp_path}/a.json").collect()}
    assert set(got) == {"build", "test"} and got["build"].inputs == ["src"] and got["build"].dependencies == ["x"] and got["build"].project == "p"
    assert sorted(r.rule for r in configs.config_violations(spark, str(tmp_path)).collect()) == ["no-tasks", "not-json"]
    locks = tmp_path / "locks"
    sinks.write_lock(configs.read_config(spark, f"{tmp_path}/a.json").drop("path", "project"), str(locks))
    (tmp_path / "v1.json").write_text(json.dumps([{"id": "old", "cmd": ["echo", "No command found for old"], "reads": ["r"]}]))
    v2 = configs.read_lock(spark, str(locks))
    assert sorted((r.id, r.version) for r in v2.collect()) == [("build", 2), ("test", 2)]
    v1 = configs.read_lock(spark, f"{tmp_path}/v1.json")
    assert [(r.id, r.version, r.inputs) for r in v1.collect()] == [("old", 1, ["r"])]
    assert [tuple(r)[1:] for r in configs.lock_summary(v1).collect()] == [(1, 1, 0)]


def test_configuration_round_trip(spark, tmp_path):
    tasks = spark.createDataFrame([("b", ["x"], ["a"], [], ["fs:src", "db:m"], True, 300_000), ("a", ["y"], [], ["o"], ["fs:q"], False, 5)], "id string, cmd array<string>, dependencies array<string>, outputs array<string>, claims array<string>, cache boolean, timeout int")
    value = json.loads(sinks.config_rows(tasks).first().value)
    assert value == {"tasks": {"a": {"cmd": ["y"], "outputs": ["o"], "cache": False, "timeout": 5}, "b": {"cmd": ["x"], "dependencies": ["a"], "claims": ["db:m"]}}}
    (tmp_path / "c.json").write_text(json.dumps(value))
    assert {r.id: r.claims for r in configs.read_config(spark, f"{tmp_path}/c.json").collect()} == {"a": None, "b": ["db:m"]}


def test_yaml_pipelines(spark, tmp_path):
    (tmp_path / "p.yml").write_text('# c\ntasks:\n  - key: build\n    run: make ${{ values.dir-a }}\n  - key: test\n    use: [build, lint]\n    after: build\n    env:\n      D: x ${{values.dir-a}} ${{ values.b.c }}\n    run: |\n      a\n      b; c\n')
    got = {r.id: (r.cmd, r.deps, r.env) for r in configs.read_step_pipeline(spark, f"{tmp_path}/p.yml", "V").collect()}
    assert got == {"build": (["make", "${{", "values.dir-a", "}}"], [], {}), "test": (["sh", "-c", "a\nb; c\n"], ["build", "lint"], {"D": "x ${V_DIR_A} ${V_B_C}"})}
    assert configs.simple_yaml("a: 1\nb:\n- x\n- 'y z'\nc: true\n") == {"a": "1", "b": ["x", "y z"], "c": True}


def test_packages_and_members(spark, tmp_path):
    (tmp_path / "package.json").write_text(json.dumps({"name": "web", "scripts": {"build": "vite"}, "dependencies": {"core": "*"}, "devDependencies": {"core": "*", "x": "1"}}))
    assert [tuple(r)[1:] for r in configs.package_scripts(spark, f"{tmp_path}/package.json").collect()] == [("web", "build", "vite")]
    assert sorted(r.name for r in configs.package_dependencies(spark, f"{tmp_path}/package.json").collect()) == ["core", "x"]
    assert spark.range(1).select(configs.cargo_members(F.lit('[workspace]\nmembers = ["a", "b/c"]'))).first()[0] == ["a", "b/c"]
    roots = spark.createDataFrame([("r", "go.mod"), ("r", "README")], "root string, name string")
    assert sorted((r.kind, r.id) for r in configs.marked_tasks(roots).collect()) == [("go", "build")]
    names = spark.createDataFrame([('"^build"',), ('{"target": "lint", "projects": "self"}',), ("plain",)], "e string").select(configs.target_dependencies(F.col("e")))
    assert [r[0] for r in names.collect()] == ["build", "lint", "plain"]


def test_tar_entries_and_frames(spark):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as t:
        for name, kind in (("ok.txt", tarfile.REGTYPE), ("../up", tarfile.REGTYPE), ("/abs", tarfile.REGTYPE), ("link", tarfile.SYMTYPE)):
            m = tarfile.TarInfo(name)
            m.type, m.size = kind, 3 if kind == tarfile.REGTYPE else 0
            t.addfile(m, io.BytesIO(b"abc"))
    df = spark.createDataFrame([("a.tar", bytearray(raw.getvalue())), ("b.tar", bytearray(b"junk" * 300))], "path string, content binary")
    got = {(r.path, r.name): r.error for r in files.tar_entries(df).collect()}
    assert got[("a.tar", "ok.txt")] is None and got[("a.tar", "../up")] == "parent" and got[("a.tar", "/abs")] == "absolute" and got[("a.tar", "link")] == "type"
    assert got[("b.tar", "")].startswith("broken")
    frames = spark.createDataFrame([("x", bytearray(files.framed('{"a": 1}', b"pay"))), ("y", bytearray(b"\xff\xff\xff\x7f{}")), ("z", bytearray(b"ab"))], "path string, content binary")
    got = {r.path: (r.metadata, r.payload and bytes(r.payload)) for r in files.frame_metadata(frames).collect()}
    assert got == {"x": ('{"a": 1}', b"pay"), "y": (None, None), "z": (None, None)}


def test_scan_and_imports(spark, tmp_path):
    for name, text in {"src/a.ts": "import {x} from './b'\nconst y = require('z')\n", "src/b.py": "from m.n import q\nimport os\n", "node_modules/c.ts": "import 'd'", ".hid/e.ts": ""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found = files.scan(spark, str(tmp_path))
    assert sorted(r.path for r in found.collect()) == ["src/a.ts", "src/b.py"]
    assert sorted(tuple(r) for r in files.imports(found).collect()) == [("src/a.ts", "./b", "static"), ("src/a.ts", "z", "static"), ("src/b.py", "m/n", "static"), ("src/b.py", "os", "static")]


SCRIPT = """// import "no"
/* require("no") */ import a, {b as c} from "./a"; import "side"; import * as d from 'd'
export { x } from "./x"; export * from './y'; export const z = "import('no')"; const q = `import("no") ${import("yes")} ${`${require("yes2")}`} from "no"`;
const r = /import "no"/; const s = a / b / require("yes3"); foo.require("no"); import(x); import type {T} from "t"
const lazy = import("../h"); let import_ = "from"; x = {import: 1}; export default from_"""
RUST = """mod a; pub mod b { }
// mod no;
/* /* mod no2; */ mod no3; */ use crate::x::{y, z};
use super::q;use std::io; let s = "mod no4;"; let r = r#"use crate::no; " mod n; "#; let c = '"'; fn f<'a>(x: &'a str) {} pub use crate::w;"""
PYTHON = """import os
import a.b as c, d
from .x import y
from ..p.q import z
from . import w
\'\'\'import no
from no import no\'\'\'
# import no
x = "import no"; import yes
if a: import yes2
from __future__ import annotations
y = (
 import_)
"""
CPP = """#include <a.h>
  # include "b/c.h"
// #include "no"
/* x
#include "no"
*/ #include "same"
char*s="\\n#include <no>";
R"(
#include "no"
)"
#include MACRO
int x; #include "no"
"""
GO = """package x
import "fmt"
import ( a "b/c"
 . "d" // "no"
 `e` )
import z "q"
func f() { x := "import"; y("no") }
"""
IMPORTED = [
    ("typescript", SCRIPT, "./a side d ./x ./y yes! yes2 yes3 t ../h!"), ("rust", RUST, "./a ./b crate::x::{y,z} super::q crate::w"), ("python", PYTHON, "os a/b ./x ./p/q ./ yes yes2"), ("cpp", CPP, "a.h b/c.h same MACRO"), ("go", GO, "fmt b/c d e q"),
    ("ruby", 'require "x"', ""), ("c", None, ""), ("javascript", "", ""), ("javascript", "`${", ""), ("rust", "/* open", ""), ("python", '"""open', ""), ("go", "import", ""),
]


def test_imports_by_syntax(spark):
    """Dynamic ones with a mark behind them."""
    from braidwork.functions.imports import READERS, imports_of

    df = spark.createDataFrame([(i, g, s) for i, (g, s, _) in enumerate(IMPORTED)], "i int, g string, s string")
    got = {}
    for r in df.lateralJoin(imports_of(F.col("s").outer(), F.col("g").outer())).collect():
        got.setdefault(r.i, []).append(r.target.replace(" ", "") + "!" * r.dynamic)
    assert got == {i: want.split() for i, (_, _, want) in enumerate(IMPORTED) if want}
    long = "import 'a';\n" * 20_000 + "`" + "x" * 100_000
    assert len(list(READERS["typescript"](long))) == 20_000


def test_function_sizes_and_volatility_of_sources(spark):
    from braidwork.functions.code import function_sizes
    from braidwork.operators import report

    source = "export async function a(x, y) {\n  if (x) {\n    for (;;) { z() }\n  }\n}\nclass K {\n  static run(a, b, c): void {\n    if (q) { w {\n    }}\n  }\n  get() {}\n}\nfunction open(\n"
    assert function_sizes(source) == [("a", 5, 2, 2), ("run", 4, 3, 3), ("get", 1, 0, 0), ("open", 1, 0, 0)]
    assert tuple(report.function_report(spark.createDataFrame([("a", source)], "path string, content string")).first()) == (4, 0, 0, 0, 0)
    files_ = spark.createDataFrame([("a", "x = 1 // 5678", "typescript"), ("b", "  ", "typescript"), ("c", "no comment", None)], "path string, content string, language string")
    assert tuple(report.scan_volatility(files_).first()) == (pytest.approx((1 - 5 / 13) / 3), 3, 1)


EVENTS = [
    (1, "exec", 10, 1, ["/bin/tsc"], None, None, "/r"), (2, "open", 10, None, None, "src/main.ts", "r", None), (3, "open", 10, None, None, "/r/dist/main.js", "w", None),
    (4, "exec", 20, 1, ["esbuild"], None, None, None), (5, "chdir", 20, None, None, "dist", None, None), (6, "open", 20, None, None, "main.js", "r", None),
    (7, "exec", 30, 1, ["test"], None, None, None), (8, "open", 30, None, None, ".git/x", "r", None), (9, "open", 30, None, None, "/tmp/x", "w", None), (10, "open", 99, None, None, "/r/q", "w", None),
    (11, "open", 30, None, None, "t.txt", "r", None),
]
KIND = "seq bigint, type string, pid bigint, ppid bigint, cmd array<string>, path string, mode string, cwd string"


def test_trace_to_pipeline_and_the_stream_agrees(spark, tmp_path):
    events = spark.createDataFrame(EVENTS, KIND)
    nodes = trace.fold(events, "/r")
    want = {10: (["src/main.ts"], ["dist/main.js"]), 20: (["dist/main.js"], []), 30: (["t.txt"], [])}
    assert {r.pid: (r.reads, r.writes) for r in nodes.collect()} == want
    tasks, edges = trace.synthesise(nodes, nodes.select("pid", F.col("pid").alias("idx")))
    assert sorted((r.name, r.claims) for r in tasks.collect()) == [("esbuild_20", ["fs:read:dist/main.js"]), ("test_30", ["fs:read:t.txt"]), ("tsc_10", ["fs:read:src/main.ts", "fs:write:dist/main.js"])]
    assert [tuple(r) for r in edges.collect()] == [(10, 20)]
    events.where("seq <= 5").coalesce(1).write.parquet(f"{tmp_path}/in")
    events.where("seq > 5").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = folds.stream_fold(folds.watch(spark, f"{tmp_path}/in", KIND), "/r")
    q = stream.writeStream.format("memory").queryName("folded").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.pid: (r.reads, r.writes) for r in spark.sql("SELECT * FROM folded").collect()} == want


def test_debounce_batch_and_stream(spark, tmp_path):
    times = ["10:00:00.000", "10:00:00.200", "10:00:00.450", "10:00:01.000"]
    df = spark.createDataFrame([("k", f"2024-01-01 {t}") for t in times], "k string, t string").select("k", F.to_timestamp("t").alias("ts"))
    assert sorted(r.n for r in folds.debounced(df, "k", "ts").collect()) == [1, 3]
    busy = {str(r.ts)[11:]: r.started for r in folds.dropped_while_busy(df, "k", "ts", 300).collect()}
    assert list(busy.values()) == [True, False, True, True]
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = folds.debounced(folds.watch(spark, f"{tmp_path}/in", "k string, ts timestamp", "0 seconds"), "k", "ts")
    q = s.writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.n for r in spark.sql("SELECT * FROM bursts").collect()] == [3]  # the last burst is still open


def test_system_trace_lines(spark):
    lines = ['10 execve("/bin/sh", ["sh", "-c", "a \\"b\\""], 0x7) = 0', "10 clone(child_stack=NULL) = 11", '[pid 11] execve("/bin/ls", ["ls"], 0x7) = 0', '11 openat(AT_FDCWD</r>, "a.txt", O_WRONLY|O_CREAT, 0666) = 3</r/a.txt>', '11 openat(AT_FDCWD, "none", O_RDONLY) = -1 ENOENT (No such file)', '11 openat(AT_FDCWD, "new", O_RDONLY|O_CREAT) = 4', '11 openat(AT_FDCWD, "both", O_RDWR) = 5', '11 chdir("/x") = 0', "no pid here", '11 open("old", O_RDONLY) = 3', "11 execve(0x7, 0x8) = 0"]
    df = spark.createDataFrame(list(enumerate(lines)), "seq int, value string")
    got = [(r.type, r.pid, r.ppid, r.cmd, r.path, r.mode) for r in files.read_system_trace(df).orderBy("seq").collect()]
    opened = [("open", 11, None, None, p, m) for p, m in (("a.txt", "w"), ("none", "r"), ("new", "w"), ("both", "w"))]
    assert got == [("exec", 10, None, ["sh", "-c", 'a \\"b\\"'], None, None), ("exec", 11, 10, ["ls"], None, None), *opened, ("chdir", 11, None, None, "/x", None)]


def test_lock_entries_as_they_must_be(spark, tmp_path):
    good = {"id": " a ", "cmd": ["x"], "deps": ["old"], "dependencies": ["new"], "outputs": ["o"], "when": {"platform": ["linux"]}}
    (tmp_path / "good.json").write_text(json.dumps({"version": 2, "tasks": [good]}))
    r = configs.read_lock(spark, f"{tmp_path}/good.json").first()
    assert (r.id, r.dependencies, r.outputs, r.inputs, r.env, r.timeout, r.cache, r.when.platform) == ("a", ["old"], ["o"], [], {}, 300_000, True, ["linux"])
    bad = [good, {"cmd": ["x"]}, {"id": "b"}, {"id": "c", "cmd": "echo hi"}, {"id": "d", "cmd": []}, {"id": "e", "cmd": ["x", 1]}, {"id": 7, "cmd": ["x"]}]
    (tmp_path / "bad.json").write_text(json.dumps(bad))
    found = {r["index"]: r.rule for r in configs.lock_violations(spark, f"{tmp_path}/bad.json").collect()}
    assert found == {1: "no-id", 2: "bad-cmd", 3: "bad-cmd", 4: "bad-cmd", 5: "bad-cmd"}
    assert sorted(r.id for r in configs.read_lock(spark, f"{tmp_path}/bad.json", strict=False).collect()) == ["7", "a"]
    with pytest.raises(Exception, match="entry 1: no-id"):
        configs.read_lock(spark, f"{tmp_path}/bad.json").collect()


YAML = [
    ("a: 1 # x\nb: 'it''s' # y\nc: \"q\\n#\"\nd: x#y\ne: http://z/#a\n", {"a": "1", "b": "it's", "c": "q\n#", "d": "x#y", "e": "http://z/#a"}),
    ("a: [ 'b, c', d, [e, \"f]\"], {g: h} ] # t\nb: {K: v, 'x y': [1, 2], \"z\": }\nc: []\nd: {}\n", {"a": ["b, c", "d", ["e", "f]"], {"g": "h"}], "b": {"K": "v", "x y": ["1", "2"], "z": None}, "c": [], "d": {}}),
    ("run: |\n  # kept\n    deep\n\n  end\nnext: y\n", {"run": "# kept\n  deep\n\nend\n", "next": "y"}),
    ("a: |-\n  x\n\nb: |+\n  y\n\nc: >\n  one\n  two\n\n  three\n", {"a": "x", "b": "y\n\n", "c": "one two\nthree\n"}),
    ("- a\n- b: 1\n  c: 2\n-\n  d: 3\n- - e\n  - f\n- |\n  g\n", ["a", {"b": "1", "c": "2"}, {"d": "3"}, ["e", "f"], "g\n"]),
    ("tasks:\n- key: x\n  after:\n  - y\n  # between\n\n  - z\n  use: true\n- key: w\n", {"tasks": [{"key": "x", "after": ["y", "z"], "use": True}, {"key": "w"}]}),
    ("---\n# only\nk:\n  l:\nm: ~\nlist: [a,\n  b, # c\n  d]\n'q r': s\n", {"k": {"l": None}, "m": None, "list": ["a", "b", "d"], "q r": "s"}),
    ("", None), ("# nothing\n", None), ("plain\n", "plain"), ("x: - not a list\ny: a: b\n", {"x": "- not a list", "y": "a: b"}),
]


@pytest.mark.parametrize("text, want", YAML)
def test_yaml(text, want):
    assert configs.simple_yaml(text) == want


def test_written_steps_with_odd_names_are_read_again(spark, tmp_path):
    rows = [("a, b", ["sh", "-c", "x # y\n  && 'z'"], ["c: d", "e#f", "it's", "[g"]), ("plain", ["run", "it"], [])]
    sinks.step_pipeline(spark.createDataFrame(rows, "id string, cmd array<string>, deps array<string>")).coalesce(1).write.text(f"{tmp_path}/steps")
    assert [tuple(r) for r in rows] == sorted((r.id, r.cmd, r.deps) for r in configs.read_step_pipeline(spark, f"{tmp_path}/steps").collect())


def test_broadcast_drops_writers_that_fail(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/in")
    got = []

    def broken(rows):
        raise ValueError

    sinks.broadcast_events(spark.readStream.schema("id bigint").parquet(f"{tmp_path}/in"), [broken, got.extend], f"{tmp_path}/cp").awaitTermination(120)
    assert len(got) == 3
    assert "\\u003c" in sinks.dashboard_json(spark.createDataFrame([(0, ["<b>"])], "wave int, task_ids array<string>")).first().json


def test_spans_are_posted_and_failures_do_not_matter(spark):
    import http.server
    import threading

    got, sizes = [], []

    class Taker(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            sent = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["resourceSpans"]
            sizes.append(len(sent))
            got.extend(x["scopeSpans"][0]["spans"][0] for x in sent)
            self.send_response(200)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Taker)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spans = spark.createDataFrame([("a", 1, 2, {"k": "v"}), ("b", 3, 4, None), ("b", 3, 4, None)], "name string, start_ms long, duration_ms long, attributes map<string,string>").coalesce(1)
    sinks.export_spans(spans, f"http://127.0.0.1:{server.server_port}/v1/traces", most=2)
    server.shutdown()
    server.server_close()
    assert sorted(x["name"] for x in got) == ["a", "b", "b"] and sorted(sizes) == [1, 2]
    a, b = ({x["name"]: x for x in got}[n] for n in "ab")
    assert a["attributes"] == [{"key": "k", "value": {"stringValue": "v"}}] and b["attributes"] == [] and (b["startTimeUnixNano"], b["endTimeUnixNano"], b["kind"]) == (3_000_000, 7_000_000, 1)
    assert len({x["traceId"] for x in got}) == 2 and {(len(x["traceId"]), len(x["spanId"])) for x in got} == {(32, 16)}
    sinks.export_spans(spans, f"http://127.0.0.1:{server.server_port}/gone", timeout=0.5)  # nobody listens any more


def test_streams_in_the_order_of_event_time(spark, tmp_path):
    """Whatever the order in which files come, and however they cut bursts and runs, the stream gives what the batch gives."""
    import random

    from braidwork.streaming import ordered

    ordered.use_rocksdb(spark)
    rng = random.Random(3)
    changes = spark.createDataFrame([(rng.choice("abc"), rng.randrange(20_000)) for _ in range(80)] + [(None, 5)], "k string, ms bigint").select("k", F.timestamp_millis("ms").alias("ts"))
    far = spark.createDataFrame([("z", 10**9)], "k string, ms bigint").select("k", F.timestamp_millis("ms").alias("ts"))
    parts = changes.randomSplit([1.0, 1.0, 1.0], seed=5)
    for part in (*parts, far):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("ts", "1 day")
    q = ordered.debounced_runs(stream, "k", "ts").writeStream.format("memory").queryName("runs").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    bursts = folds.debounced(changes.where("k IS NOT NULL"), "k", "ts").select("k", (F.unix_millis("last") + 300).alias("ms"), "n")
    started = folds.dropped_while_busy(bursts.select("k", F.timestamp_millis("ms").alias("ts")), "k", "ts", 1000).select("k", F.unix_millis("ts").alias("ms"), "started")
    want = sorted(tuple(r) for r in bursts.join(started, ["k", "ms"]).select("k", "ms", "n", "started").collect())
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM runs").collect()) == want and {r[3] for r in want} == {True, False}


def test_a_trace_out_of_order_folds_as_in_order(spark, tmp_path):
    from braidwork.streaming import ordered

    ordered.use_rocksdb(spark)
    events = spark.createDataFrame(EVENTS, KIND).withColumn("ts", F.timestamp_seconds("seq"))
    for seqs in ([3, 6, 9, 11], [5, 4, 1, 8], [10, 2, 7]):
        events.where(F.col("seq").isin(seqs)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events.where("seq = 1").withColumns({"pid": F.lit(-1).cast("bigint"), "ts": F.timestamp_seconds(F.lit(10**9))}).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("ts", "1 day")
    q = ordered.ordered_fold(stream, "/r").writeStream.format("memory").queryName("in_order").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {r.pid: (r.cmd, r.reads, r.writes) for r in spark.sql("SELECT * FROM in_order").collect()}
    assert got == {r.pid: (r.cmd, r.reads, r.writes) for r in trace.fold(events, "/r").collect()} and len(got) == 3


def test_objects_are_opened_by_name_and_written_whole(spark, tmp_path):
    from braidwork.sources import objects

    root = str(tmp_path / "store")
    rows = spark.createDataFrame([(f"o{i}", bytearray(b"x" * i)) for i in range(200)], "hash string, content binary").repartition(3)
    objects.push(rows, root)
    assert {r.hash: len(r.content) for r in objects.stored(spark, root).collect()} == {f"o{i}": i for i in range(200)}
    assert sorted(p.name for p in (tmp_path / "store").iterdir()) == sorted(f"o{i}" for i in range(200))
    few = objects.stored(spark, root).where(F.col("hash").isin("o1", "o2", "gone"))
    assert few.rdd.getNumPartitions() == 1 < objects.stored(spark, root).rdd.getNumPartitions() and sorted(r.hash for r in few.collect()) == ["o1", "o2"]
    wanted = spark.createDataFrame([("o3",), ("gone",), ("../o3",), (None,), ("o3",)], "hash string")
    for most in (100, 0):  # by filters, by a join
        assert sorted((str(r.hash), r.found, r.content and len(r.content)) for r in objects.pulled(wanted, root, most).collect()) == [("../o3", False, None), ("None", False, None), ("gone", False, None), ("o3", True, 3), ("o3", True, 3)]
    with pytest.raises(Exception, match="no name for an object"):
        objects.push(spark.createDataFrame([("new", bytearray(b"1")), ("../bad", bytearray(b"2"))], "hash string, content binary").coalesce(1), root)
    assert objects.stored(spark, root).count() == 200  # nothing of the push that failed
    assert objects.stored(spark, str(tmp_path / "nowhere")).count() == 0


def test_a_batch_that_is_tried_again_is_delivered_once(spark, tmp_path):
    from pyspark.sql import Row

    from braidwork.sources import objects

    w = objects.EventWriter(str(tmp_path))
    first, again, other = (w.write(iter([Row(id=1), Row(id=2)])), w.write(iter([Row(id=1), Row(id=2)])), w.write(iter([Row(id=3)])))
    lost = w.write(iter([Row(id=9)]))
    w.abort([lost, None], 0)
    w.commit([first, None], 0)
    w.commit([again, None], 0)
    w.commit([other], 1)
    assert sorted(r.id for r in spark.read.json(f"{tmp_path}/events").collect()) == [1, 2, 3]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["committed", "events"]


def test_an_upsert_writes_the_buckets_it_touches(spark, tmp_path):
    from braidwork.operators.ledger import upsert
    from braidwork.sources import bucketed

    base = str(tmp_path / "ledger")
    df = lambda rows: spark.createDataFrame(rows, "logic_hash string, timestamp bigint, v string")
    old = df([(f"k{i}", i, "old") for i in range(60)] + [("k1", 100, "newer")])
    bucketed.create(old, base, buckets=8)
    new = df([("k3", 200, "a"), ("k3", 300, "b"), ("fresh", 1, "c")])
    before = bucketed.manifest(spark, base)
    after = bucketed.upsert(new, base)
    moved = {b for b, f in after["folders"].items() if before["folders"].get(b) != f}
    assert 1 <= len(moved) <= 2 and len(before["folders"]) == 8
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    want = rows(upsert(upsert(old.limit(0), old), new))
    assert rows(bucketed.read(spark, base)) == want and len(want) == 61
    assert rows(bucketed.read(spark, base, version=1)) == rows(upsert(old.limit(0), old))
    asked = bucketed.read(spark, base, keys=["k3", "nobody"])
    assert rows(asked) == [("k3", 300, "b")] and len(asked.inputFiles()) <= 2
    with pytest.raises(bucketed.Conflict):
        bucketed._commit(spark, base, after)  # another writer's version 2
    bucketed.upsert(df([("k3", 1, "d")]), base)
    assert bucketed.vacuum(spark, base, kept=1) > 0 and rows(bucketed.read(spark, base, keys=["k3"])) == [("k3", 1, "d")] and bucketed.manifest(spark, base)["version"] == 3
    with pytest.raises(FileNotFoundError):
        bucketed.read(spark, str(tmp_path / "none"))


def test_a_tree_that_is_kept_up_is_that_of_the_files(spark):
    from braidwork.operators import hashing

    files_ = {"a/x": "1", "a/y": "2", "a/b/z": "3", "c/d/e/f": "4", "top": "5"}
    df = lambda m: spark.createDataFrame(sorted(m.items()), "path string, hash string")
    whole = lambda m: {r.path: r.hash for r in df(m).unionByName(hashing.merkle(df(m))).collect()}
    tree = df(whole(files_))
    for change in ({"a/b/z": "9"}, {"c/d/e/f": None}, {"n/e/w": "7", "a/x": None}, {"top": "6", "a/y": "8", "a/b/new": "1"}, {"a/y": "2"}):
        after = {k: v for k, v in {**files_, **change}.items() if v is not None}
        got = {r.path: r.hash for r in hashing.merkle_updated(tree, spark.createDataFrame(list(change.items()), "path string, hash string")).collect()}
        assert got == whole(after)


@pytest.mark.parametrize("form", [tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_tar_headers_are_those_of_the_format(form):
    """Against the archive's own list: long names, prefixes, other alphabets, directories, empty files; and what may not be extracted."""
    from braidwork.sources.files import tar_headers

    names = ["a.txt", "d/" + "x" * 95, "/".join(["p" * 40] * 4), "empty", *(["é/ü.txt", "/".join(["q" * 50] * 9)] if form != tarfile.USTAR_FORMAT else [])]
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w", format=form) as t:
        for i, name in enumerate(names):
            m = tarfile.TarInfo(name)
            m.size = 0 if name == "empty" else 500 * i + 12
            t.addfile(m, io.BytesIO(b"z" * m.size))
        folder = tarfile.TarInfo("folder")
        folder.type = tarfile.DIRTYPE
        t.addfile(folder)
        for name, kind in (("dev", tarfile.CHRTYPE), ("hard", tarfile.LNKTYPE), ("C:\\x", tarfile.REGTYPE), ("a\\..\\b", tarfile.REGTYPE)):
            m = tarfile.TarInfo(name)
            m.type = kind
            t.addfile(m)
    raw.seek(0)
    with tarfile.open(fileobj=raw) as t:
        want = [(m.name, "file" if m.isreg() else "directory" if m.isdir() else "other", m.size, m.offset_data) for m in t]
    got = list(tar_headers(raw.getvalue()))
    assert [g[:4] for g in got] == want and [g[4] for g in got] == [None] * (len(names) + 1) + ["type", "type", "absolute", "parent"]
    assert list(tar_headers(b"")) == [] == list(tar_headers(b"\0" * 2048)) and list(tar_headers(b"junk" * 300))[0][4].startswith("broken")
    cut = raw.getvalue()[: want[1][3] + 5]
    assert [g[0] for g in tar_headers(cut)] == names[:2]


def test_stored_steps_expire_by_age(spark, tmp_path):
    import os

    from braidwork.plans import session

    for name, age in (("old-" + "0" * 32, 7200), ("new-" + "1" * 32, 60), ("someone-elses", 7200)):
        (tmp_path / name / "part").mkdir(parents=True)
        at = (tmp_path / name).stat().st_mtime - age
        os.utime(tmp_path / name, (at, at))
    assert session.expire_steps(spark, 1.0, str(tmp_path)) == 1
    assert sorted(p.name for p in tmp_path.iterdir()) == ["new-" + "1" * 32, "someone-elses"]
    assert session.expire_steps(spark, 1.0, str(tmp_path / "none")) == 0
