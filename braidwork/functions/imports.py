"""What source files import, by a lexer with states for comments, strings and templates: a table function to join laterally.

Only tokens count, so an import in a comment, a string or a template's text is none. Six languages; each has a reader of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql.functions import udtf

Token = tuple[str, str, int, int]  # kind, text, begin, end
Import = tuple[str, bool]  # target, whether it is dynamic

_SCRIPT = re.compile(r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<word>[A-Za-z_$][\w$]*)|(?P<tick>`)|(?P<mark>.)""", re.S)
_CHUNK = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{|\Z)", re.S)
_PATTERN = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
#: Words and marks before which a slash divides; behind anything else it begins a pattern.
_DIVIDES = re.compile(r"[\w$)\]}\"'`]$")
_BEFORE_PATTERN = frozenset("return typeof case in of delete void instanceof new do else yield await throw".split())


def _script_tokens(source: str) -> Iterator[Token]:
    """Tokens of TypeScript and JavaScript; what stands in a template's braces is code again."""
    at, last, open_ = 0, "", []  # open_: depth of braces in each template that is open
    while at < len(source):
        if source[at] == "/" and (not _DIVIDES.search(last) or last in _BEFORE_PATTERN) and (m := _PATTERN.match(source, at)):
            at, last = m.end(), "/)"
            continue
        m = _SCRIPT.match(source, at)
        begin, at, kind = at, m.end(), m.lastgroup
        if kind == "skip":
            continue
        text = m[0]
        if kind == "tick" or text == "}" and open_ and not open_[-1]:
            if kind != "tick":
                open_.pop()
            chunk = _CHUNK.match(source, at)
            at, last = chunk.end(), "`"
            if chunk[1] == "${":
                open_.append(0)
                last = "{"
            yield "template", "", begin, at
            continue
        if open_ and text in "{}":
            open_[-1] += 1 if text == "{" else -1
        last = text
        yield kind, text, begin, at


def script_imports(source: str) -> Iterator[Import]:
    """`import` and `export` with a source, `require` of a text, and `import()`, which is dynamic."""
    tokens = list(_script_tokens(source))
    text = lambda i: tokens[i][1] if 0 <= i < len(tokens) else ""
    is_string = lambda i: 0 <= i < len(tokens) and tokens[i][0] == "string"
    for i, (kind, word, _, _) in enumerate(tokens):
        if kind != "word" or text(i - 1) == ".":
            continue
        if word in ("import", "require") and text(i + 1) == "(":
            if is_string(i + 2):
                yield text(i + 2)[1:-1], word == "import"
        elif word == "import" and is_string(i + 1):
            yield text(i + 1)[1:-1], False
        elif word == "import" and text(i + 1) not in (":", "", ".") or word == "export" and (text(i + 1) in ("*", "{") or text(i + 1) == "type" and text(i + 2) in ("*", "{")):
            j = i + 1
            while j < len(tokens) and (tokens[j][0] == "word" and text(j) not in ("import", "export") or text(j) in ("{", "}", "*", ",") or is_string(j) and text(j - 1) in ("as", "{", ",")) and not (text(j) == "from" and is_string(j + 1)):
                j += 1
            if text(j) == "from" and is_string(j + 1):
                yield text(j + 1)[1:-1], False


_RUST = re.compile(r"""(?P<skip>\s+|//[^\n]*)|(?P<block>/\*)|(?P<string>b?r(?P<hash>\#*)"(?:.*?)"(?P=hash)|b?"(?:[^"\\]|\\.)*"|b?'(?:[^'\\\n]|\\[^\n]{1,10}?)')|(?P<word>(?:r\#)?[A-Za-z_]\w*)|(?P<mark>.)""", re.S)


def rust_imports(source: str) -> Iterator[Import]:
    """Modules by their names, and what is used of this crate or the one above, as it is written."""
    at, tokens = 0, []
    while at < len(source):
        m = _RUST.match(source, at)
        if m.lastgroup == "block" or m["block"]:
            depth, at = 1, m.end()
            while depth and (n := re.compile(r"/\*|\*/").search(source, at)):  # they nest
                depth, at = depth + (1 if n[0] == "/*" else -1), n.end()
            at = len(source) if depth else at
            continue
        if not m["skip"]:
            tokens.append((m[0], m.start(), m.end(), bool(m["word"])))
        at = m.end()
    for i, (word, _, end, named) in enumerate(tokens[:-1]):
        if word == "mod" and tokens[i + 1][3] and i + 2 < len(tokens) and tokens[i + 2][0] in (";", "{"):
            yield f"./{tokens[i + 1][0]}", False
        elif word == "use" and named and tokens[i + 1][0] in ("crate", "super"):
            stop = next((t for t in tokens[i + 1 :] if t[0] == ";"), None)
            if stop and (text := source[end : stop[1]].strip()).startswith(("crate::", "super::")):
                yield text, False


_PYTHON = re.compile(r"""(?P<skip>[ \t\f\r]+|\#[^\n]*|\\\n)|(?P<string>(?i:[rbuft]{0,3})(?:\"{3}(?:[^\\]|\\.)*?(?:\"{3}|\Z)|'{3}(?:[^\\]|\\.)*?(?:'{3}|\Z)|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'))|(?P<word>[^\W\d]\w*(?:\.[^\W\d]\w*)*)|(?P<dots>\.+(?:[^\W\d]\w*(?:\.[^\W\d]\w*)*)?)|(?P<line>\n)|(?P<mark>.)""", re.S)


def python_imports(source: str) -> Iterator[Import]:
    """Modules as paths, the first of a list; a relative one from where the file is, whatever the number of its dots."""
    tokens = [(m.lastgroup, m[0]) for m in _PYTHON.finditer(source) if m.lastgroup != "skip"]
    fresh = True  # at the beginning of a statement
    for i, (kind, word) in enumerate(tokens):
        after = tokens[i + 1] if i + 1 < len(tokens) else ("", "")
        if fresh and word == "import" and after[0] == "word":
            yield after[1].replace(".", "/"), False
        elif fresh and word == "from" and after[0] in ("word", "dots") and tokens[i + 2 : i + 3] == [("word", "import")] and after[1] != "__future__":
            yield ("./" + after[1].lstrip(".").replace(".", "/") if after[1][0] == "." else after[1].replace(".", "/")), False
        fresh = kind == "line" or word in (";", ":")


_C = re.compile(r"""(?P<skip>[ \t\r\f]+|\\\r?\n|//(?:[^\n\\]|\\.)*|/\*.*?(?:\*/|\Z))|(?P<raw>R"(?P<tag>[^()\\\s]{0,16})\(.*?\)(?P=tag)")|(?P<include>\#[ \t]*include[ \t]*(?:<(?P<a>[^>\n]+)>|"(?P<b>[^"\n]+)"|(?P<c>[A-Za-z_]\w*)))|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<line>\n)|(?P<mark>.)""", re.S)


def c_imports(source: str) -> Iterator[Import]:
    """Included files; the mark must be the first on its line."""
    fresh = True
    for m in _C.finditer(source):
        if m["include"] and fresh:
            yield m["a"] or m["b"] or m["c"], False
        fresh = bool(m["line"]) or fresh and bool(m["skip"])


_GO = re.compile(r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:[^"\\\n]|\\.)*"|`[^`]*`)|(?P<rune>'(?:[^'\\\n]|\\.)*')|(?P<word>\w+)|(?P<mark>.)""", re.S)


def go_imports(source: str) -> Iterator[Import]:
    """Packages of import declarations, single and grouped, with and without names of their own."""
    tokens = [(m.lastgroup, m[0]) for m in _GO.finditer(source) if m.lastgroup != "skip"]
    i = 0
    while i < len(tokens):
        if tokens[i] == ("word", "import"):
            grouped = tokens[i + 1 : i + 2] == [("mark", "(")]
            i += 1 + grouped
            while i < len(tokens) and (tokens[i][0] in ("word", "string") or tokens[i][1] in (".", ";")):
                kind, text = tokens[i]
                if kind == "word" and text in ("func", "type", "var", "const", "import"):
                    break
                i += 1
                if kind == "string":
                    yield text[1:-1], False
                    if not grouped:
                        break
            continue
        i += 1


READERS = {"typescript": script_imports, "javascript": script_imports, "rust": rust_imports, "python": python_imports, "c": c_imports, "cpp": c_imports, "go": go_imports}


@udtf(returnType="target string, dynamic boolean")
class imports_of:  # noqa: N801  called like a function
    """(target, dynamic) of each import of a source text in a language, in order; none for a language without a reader, or a null text."""

    def eval(self, source: str, language: str):
        if source is not None and language in READERS:
            yield from READERS[language](source)
