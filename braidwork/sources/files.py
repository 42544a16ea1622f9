"""Readers of source trees, archives, framed objects and traces."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.functions.text import LANGUAGES

IGNORED = ("node_modules", ".git", "dist", "target", "venv", ".venv")


def scan(spark: SparkSession, root: str, suffixes: tuple[str, ...] = tuple(sorted(LANGUAGES)), ignored: tuple[str, ...] = IGNORED, most: int | None = None) -> DataFrame:
    """(path, content, length, modificationTime) of the source files below root, relative paths, ignored directories and
    dot entries left out. `most` keeps the first so many by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file:")
    relative = F.regexp_extract("path", f"{base}/(.*)$", 1)
    kept = files.withColumn("path", relative).where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes) & ~F.col("path").rlike(r"(^|/)(" + "|".join(x.replace(".", r"\.") for x in ignored) + r")/") & ~F.col("path").rlike(r"(^|/)\."))
    out = kept.select("path", "content", "length", "modificationTime")
    return out if most is None else out.orderBy("path").limit(most)


def imports(files: DataFrame) -> DataFrame:
    """files (path, content). (source, target, kind static|dynamic), by the syntax of the languages that functions.imports reads; each once a file."""
    from braidwork.functions.imports import imports_of
    from braidwork.functions.text import language

    read = files.select("path", F.col("content").cast("string").alias("_text"), language(F.col("path")).alias("_language"))
    found = read.lateralJoin(imports_of(F.col("_text").outer(), F.col("_language").outer()))
    return found.select(F.col("path").alias("source"), "target", F.when(F.col("dynamic"), "dynamic").otherwise("static").alias("kind")).distinct()


BLOCK = 512
#: Bytes of magic that a header may have: of the standard, of GNU's, of none.
_MAGICS = (b"ustar", b"ustar ", b"")


def _text(raw: bytes) -> str:
    return raw.rstrip(b"\0").decode("utf-8", "replace")


def _octal(raw: bytes) -> int:
    digits = re.match(rb"[0-7]*", raw.strip(b"\0 "))[0]
    return int(digits, 8) if digits else 0


def _records(raw: bytes) -> dict[str, str]:
    """Records of an extended header, each "length key=value" and a line feed; the length counts itself."""
    out, at = {}, 0
    while m := re.compile(rb"(\d+) ").match(raw, at):
        if not (n := int(m[1])):
            break
        key, eq, value = raw[m.end() : at + n - 1].partition(b"=")
        if eq and key:
            out[_text(key)] = _text(value)
        at += n
    return out


def tar_headers(content: bytes) -> Iterator[tuple[str, str, int, int, str | None]]:
    """(name, type, size, offset of the data, error) of a tar archive's entries, long names and extended headers resolved.

    An error says why an entry may not be extracted: `type` for links, devices and what else is no file or directory, `absolute`, `parent`, `empty`; or, with an
    empty name and as the last, `broken` for what is no header.
    """
    at, long, more = 0, None, {}
    while at + BLOCK <= len(content) and any(head := content[at : at + BLOCK]):
        size, flag, data = _octal(head[124:136]), head[156:157], at + BLOCK
        if head[257:263].rstrip(b"\0") not in _MAGICS:
            yield "", "", 0, at, "broken: no header"
            return
        at = data + -(-size // BLOCK) * BLOCK
        if flag == b"L":
            long = _text(content[data : data + size])
        elif flag in (b"x", b"g"):
            more = _records(content[data : data + size])
        else:
            short, before = _text(head[:100]), _text(head[345:500]) if head[257:263] != b"ustar " else ""
            name = more.get("path") or long or (f"{before}/{short}" if before else short)
            long, more = None, {}
            folder = flag == b"5" or name.endswith("/")
            kind = "directory" if folder else "file" if flag in (b"", b"\0", b"0") else "other"
            parts = name.replace("\\", "/").split("/")
            bad = "type" if kind == "other" else "empty" if not name else "absolute" if name[0] == "/" or re.match(r"[a-zA-Z]:[\\/]", name) else "parent" if ".." in parts else None
            yield name.rstrip("/") if folder else name, kind, 0 if folder else size, data, bad


@F.udtf(returnType="name string, type string, size bigint, offset bigint, error string")
class tar_listing:  # noqa: N801  called like a function
    """tar_headers of a column; nothing for a null."""

    def eval(self, content: bytes):
        if content is not None:
            yield from tar_headers(content)


def tar_entries(archives: DataFrame) -> DataFrame:
    """archives (path, content). One row an entry (path, name, type, size, offset, error); error is null for entries that are safe to extract."""
    return archives.select("path", "content").lateralJoin(tar_listing(F.col("content").outer())).select("path", "name", "type", "size", "offset", "error")


def frame_metadata(frames: DataFrame, most: int = 1 << 20) -> DataFrame:
    """frames (path, content): 4-byte little-endian length, JSON, payload. (path, metadata, payload); both null if corrupt or longer than `most`."""
    size = F.expr("cast(conv(hex(substring(content,4,1)),16,10) as bigint)*16777216 + cast(conv(hex(substring(content,3,1)),16,10) as bigint)*65536 + cast(conv(hex(substring(content,2,1)),16,10) as bigint)*256 + cast(conv(hex(substring(content,1,1)),16,10) as bigint)")
    sized = frames.select("path", "content", size.alias("n"))
    whole = (F.octet_length("content") >= 4) & (F.col("n") <= most) & (F.octet_length("content") >= F.col("n") + 4)
    text = F.when(whole, F.expr("cast(substring(content, 5, cast(n as int)) as string)"))
    ok = F.try_parse_json(text).isNotNull()
    return sized.select("path", F.when(ok, text).alias("metadata"), F.when(ok, F.expr("substring(content, cast(n as int) + 5)")).alias("payload"))


def framed(metadata: str, payload: bytes) -> bytes:
    raw = metadata.encode()
    return struct.pack("<I", len(raw)) + raw + payload


def read_system_trace(lines: DataFrame) -> DataFrame:
    """lines (seq, value) of a system-call trace with pids. (seq, type, pid, ppid, cmd, path, mode, cwd) for trace.fold.

    A fork's result names the child; an exec takes the parent that the last fork before it gave its pid. An open that writes, may write or
    creates is `w`, any other `r`. Failed calls count as the others do: what a process tried to read is its input all the same. Lines without a pid and
    calls whose arguments can't be read are dropped.
    """
    from pyspark.sql import Window

    v = F.col("value")
    pid = F.coalesce(*[F.nullif(F.regexp_extract(v, p, 1), F.lit("")) for p in (r"^\[pid\s+(\d+)\]", r"^(\d+)\s")]).cast("bigint")
    call = F.when(v.contains("clone(") | v.contains("fork("), "fork").when(v.contains("execve("), "exec").when(v.contains("chdir("), "chdir").when(v.contains("openat("), "open")
    own = lines.select("seq", pid.alias("pid"), call.alias("type"), v.alias("v")).where(F.col("pid").isNotNull() & F.col("type").isNotNull())
    child = F.nullif(F.regexp_extract("v", r"=\s+(\d+)$", 1), F.lit("")).cast("bigint")
    listed = r'execve\("[^"]+",\s*\[(.*?)\]'
    args = F.regexp_extract_all(F.regexp_extract("v", listed, 1), F.lit(r'"([^"\\]*(?:\\.[^"\\]*)*)"'), F.lit(1))
    path = F.when(F.col("type") == "chdir", F.regexp_extract("v", r'chdir\("([^"]+)"\)', 1)).when(F.col("type") == "open", F.regexp_extract("v", r'openat\([^,]+,\s*"([^"]+)"', 1))
    mode = F.when(F.col("type") == "open", F.when(F.col("v").rlike("O_WRONLY|O_RDWR|O_CREAT"), "w").otherwise("r"))
    is_fork = F.col("type") == "fork"
    told = own.select("seq", "type", F.when(is_fork, child).otherwise(F.col("pid")).alias("pid"), F.when(is_fork, F.col("pid")).alias("ppid"), F.when(F.col("type") == "exec", args).alias("cmd"), path.alias("path"), mode.alias("mode"), (~is_fork & (F.col("type") == "exec") & ~F.col("v").rlike(listed)).alias("odd"))
    told = told.where(F.col("pid").isNotNull() & ~F.col("odd") & (F.col("path").isNull() | (F.col("path") != ""))).withColumn("ppid", F.last("ppid", ignorenulls=True).over(Window.partitionBy("pid").orderBy("seq")))
    return told.where(F.col("type") != "fork").select("seq", "type", "pid", F.when(F.col("type") == "exec", F.col("ppid")).alias("ppid"), "cmd", "path", "mode", F.lit(None).cast("string").alias("cwd"))
