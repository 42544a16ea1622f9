"""Secret scans with multipart credential linking.

Strong parts (assignments, access identifiers, long hex) are reported wherever they stand. Weak candidates
(account names, bare 40-character tokens, endpoints) mean little alone, so each becomes an interval stretched
by the scope's reach, and an interval join inside the scope keeps it only where a complementary part co-occurs:

    identifier  needs a secret        (assign, hex or bare)
    bare        needs an identifier   (access or identifier)
    endpoint    needs a secret or an access identifier

A scope never spans documents: it is the stretch of a document between blank lines. The join sorts the parts
of a scope by start and sweeps, so its work is n log n in the parts whatever their number; no pairs are kept.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import extended

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "identifier", "bare", "endpoint")

# The three base patterns with the least length that counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, as [0-9a-f]+ finds them, of 24 or more
LEAST_VALUE, LEAST_ACCESS = 6, 20

# The weak candidates, reported only with a complementary part near.
IDENTIFIER = re.compile(r"""(?:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", re.I | re.A)
BARE = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])")
ENDPOINT = re.compile(r"""(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp)://[^\s"'<>]+""", re.A)
BLANK = re.compile(r"\n[ \t\r]*\n")

FINDINGS = "array<struct<kind:string,start:bigint,end:bigint,scope:int,parts:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("scope", pa.int32()), ("parts", pa.int32())]))
_SECRET, _ACCOUNT = ("assign", "hex", "bare"), ("access", "identifier")
_NEEDS = {"identifier": _SECRET, "bare": _ACCOUNT, "endpoint": (*_SECRET, "access")}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The strong parts of a text as (start, end, kind), unordered."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


class _Near:
    """Parts of some kinds, for asking how many lie within reach of a span (those it overlaps exactly excluded)."""

    def __init__(self, parts: list[tuple[int, int, str]]):
        self.starts, self.ends = sorted(p[0] for p in parts), sorted(p[1] for p in parts)

    def count(self, start: int, end: int) -> int:
        """Parts that begin before `end` less those that ended by `start`."""
        return bisect_left(self.starts, end) - bisect_right(self.ends, start)


def link(text: str, reach: int) -> list[dict]:
    """All findings of one text by start, then kind in KINDS' order; scope numbers its stretch, parts the complements."""
    strong = base_spans(text)
    weak = [(m.start(), m.end(), k) for k, p in (("identifier", IDENTIFIER), ("bare", BARE), ("endpoint", ENDPOINT)) for m in p.finditer(text)]
    if not strong and not weak:
        return []
    cuts = [m.start() for m in BLANK.finditer(text)]
    scopes: dict[int, list[tuple[int, int, str]]] = {}
    for p in strong + weak:
        scopes.setdefault(bisect_right(cuts, p[0]), []).append(p)
    out = []
    for number, parts in scopes.items():
        near = {k: _Near([p for p in parts if p[2] == k]) for k in KINDS}
        complements = {"assign": _ACCOUNT, "hex": _ACCOUNT, "access": _SECRET, **_NEEDS}
        for start, end, kind in parts:
            linked = sum(near[k].count(start - reach, end + reach) for k in complements[kind])
            if linked or kind not in _NEEDS:
                out.append({"kind": kind, "start": start, "end": end, "scope": number, "parts": linked})
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda f: (f["start"], rank[f["kind"]], f["end"]))


def credential_findings(docs: DataFrame, text: str = "text", reach: int = 400) -> DataFrame:
    """docs without its text column, with `findings` (an array, empty where nothing was found).

    Offsets are code points of the whole text, ends exclusive. A null text counts as empty; repeated rows are
    scanned each for itself; an empty table gives no rows; a column named findings is replaced.
    """
    keep = [c for c in docs.columns if c not in (text, "findings")]
    schema = extended(docs.select(*keep).schema, f"findings {FINDINGS}")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([link(t.as_py() or "", reach) for t in b.column(len(keep))], _ARROW)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], found], [*keep, "findings"])

    return docs.select(*keep, text).mapInArrow(scan, schema)


def listed(findings: str, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the findings of these kinds, comma-joined."""
    return F.array_join(F.transform(F.filter(findings, lambda f: f.kind.isin(*kinds)), lambda f: F.concat_ws(":", f.kind, f.start.cast("string"), f.end.cast("string"))), ",")
