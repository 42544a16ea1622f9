"""Comment stripping, keyed hashes and other functions that need Python, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How each family writes comments and strings.
_SLASH = ("//",), (("/*", "*/"),), ('"', "'")
FAMILIES = {
    "c": _SLASH, "cpp": _SLASH, "csharp": _SLASH, "java": _SLASH, "kotlin": _SLASH, "swift": _SLASH, "rust": _SLASH,
    "go": (("//",), (("/*", "*/"),), ('"', "'", "`")), "javascript": (("//",), (("/*", "*/"),), ('"', "'", "`")), "typescript": (("//",), (("/*", "*/"),), ('"', "'", "`")),
    "php": (("//", "#"), (("/*", "*/"),), ('"', "'")), "python": (("#",), (('"""', '"""'), ("'''", "'''")), ('"', "'")), "ruby": (("#",), (("=begin", "=end"),), ('"', "'")),
}


def _scanner(language: str) -> re.Pattern:
    lines, blocks, quotes = FAMILIES[language]
    parts = [f"(?P<open>{'|'.join(re.escape(o) for o, _ in blocks)})", f"(?P<line>{'|'.join(re.escape(x) for x in lines)})[^\\n]*"]
    parts += [rf"(?P<q{i}>{re.escape(q)}(?:\\.|(?!{re.escape(q)})[^\\])*(?:{re.escape(q)}|\Z))" for i, q in enumerate(quotes)]
    return re.compile("|".join(parts), re.S)


_SCANNERS: dict[str, re.Pattern] = {}


def strip_comments(source: str, language: str) -> str:
    """Source without comments, white space as single spaces. Block comments nest where opening and closing differ."""
    if language not in FAMILIES:
        return " ".join(source.split())
    scanner = _SCANNERS.setdefault(language, _scanner(language))
    closing = dict(FAMILIES[language][1])
    out, at = [], 0
    while m := scanner.search(source, at):
        out.append(source[at : m.start()])
        if m["open"]:
            opened, close, depth, at = m["open"], closing[m["open"]], 1, m.end()
            marks = re.compile("|".join(sorted({re.escape(opened), re.escape(close)})))
            while depth and (n := marks.search(source, at)):
                depth += 1 if n[0] == opened and opened != close else -1
                at = n.end()
            at = len(source) if depth else at
            out.append(" ")
        else:
            out.append(" " if m["line"] else m[0])
            at = m.end()
    return " ".join("".join([*out, source[at:]]).split())


@F.pandas_udf(T.StringType())
def stripped(source: pd.Series, language: pd.Series) -> pd.Series:
    """strip_comments by row; without a known language only white space collapses, null stays null."""
    return pd.Series([None if s is None else strip_comments(s, g or "") for s, g in zip(source, language)])


@F.pandas_udf(T.StringType())
def hmac_sha256(key: pd.Series, message: pd.Series) -> pd.Series:
    """HMAC-SHA256 in lower-case hex; null with either null."""
    return pd.Series([None if k is None or m is None else hmac.new(k.encode(), m.encode(), hashlib.sha256).hexdigest() for k, m in zip(key, message)])


def _segment(raw: bytes) -> str:
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def _signed(head: str, key: str) -> str:
    return f"{head}.{_segment(hmac.new(key.encode(), head.encode(), hashlib.sha256).digest())}"


@F.pandas_udf(T.StringType())
def token(claims: pd.Series, key: pd.Series) -> pd.Series:
    """A JSON web token (HS256) over the claims' JSON text as it is; null with either null."""
    head = _segment(b'{"alg":"HS256","typ":"JWT"}')
    return pd.Series([None if c is None or k is None else _signed(f"{head}.{_segment(c.encode())}", k) for c, k in zip(claims, key)])


@F.pandas_udf(T.StringType())
def token_claims(tokens: pd.Series, key: pd.Series, now: pd.Series) -> pd.Series:
    """The claims' JSON text of a token of three segments that this key has signed and whose exp is after `now`; null for any other."""

    def one(text: str | None, k: str | None, t: float) -> str | None:
        parts = (text or "").split(".")
        if k is None or len(parts) != 3 or not hmac.compare_digest(_signed(".".join(parts[:2]), k).encode(), text.encode()):
            return None
        try:
            raw = base64.urlsafe_b64decode(parts[1] + "=" * (-len(parts[1]) % 4)).decode()
            return raw if json.loads(raw)["exp"] > t else None
        except (ValueError, KeyError, TypeError):
            return None

    return pd.Series([one(x, k, t) for x, k, t in zip(tokens, key, now)])


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON with sorted keys and no spaces; null for what isn't JSON."""

    def one(s: str | None) -> str | None:
        try:
            return None if s is None else json.dumps(json.loads(s), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return text.map(one)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("lines", "parameters", "depth")]])))
def functions_of(source: pd.Series) -> pd.Series:
    """function_sizes by row."""
    return pd.Series([[dict(zip(("name", "lines", "parameters", "depth"), f)) for f in function_sizes(s or "")] for s in source])


_FUNCTION = re.compile(r"\s*(?:export\s+)?(?:static\s+)?(?:async\s+)?(?:function\s+(\w+)|(\w+)\s*\([^)]*\)\s*[:{])")
_NO_NAMES = frozenset("if for while switch catch try".split())


def function_sizes(source: str) -> list[tuple[str, int, int, int]]:
    """(name, lines, parameters, depth) of each line that begins a function or a method.

    A function ends on the line whose last brace closes its first; without one it has one line. depth is the most braces
    that are open at the end of any of its lines; parameters are those on its first line.
    """
    lines = source.split("\n")
    change = [x.count("{") - x.count("}") for x in lines]
    out = []
    for i, line in enumerate(lines):
        m = _FUNCTION.match(line)
        name = m and (m[1] or m[2])
        if not name or name in _NO_NAMES:
            continue
        depth, most, begun, end = 0, 0, False, i
        for j in range(i, len(lines)):
            depth += change[j]
            begun = begun or "{" in lines[j]
            if begun:
                most = max(most, depth)
                if not depth:
                    end = j
                    break
        listed = re.search(r"\(([^)]*)\)", line)
        out.append((name, end - i + 1, len([p for p in listed[1].split(",") if p.strip()]) if listed else 0, most))
    return out
