"""Main-text extraction by union-free regular-expression inference.

A page's token stream (block tags and the texts between them, with implied end tags put in) becomes a wrapper: an
expression of tags, texts, optional parts and repeated groups, without unions. Wrappers of a host's pages are
aligned one after another: texts that differ become slots, parts that one side lacks become optional, neighbours
of one kind fold into a repeated group, and a long run of mixed kinds into a repeated group of optional parts, so an
alignment never costs more than PARTS squared. A slot keeps what its texts are like over all pages: how long, how much
of them is links, and whether they come again on pages of different content.

The wrapper then says what a page's parts are. A text that stands on SEVERAL pages of different content at one place
is template; a place whose texts come again and again, or that lists links, is a menu or a notice whatever its names
are; the article is the region whose slots hold the new prose. What a page's content is, its longest text tells: pages that
have it in common are copies of one article, however much their adverts differ, and what stands on them all is no template.
Tags are prior knowledge: an article or main element is the article if the host's pages have a fair part of their new text
there, and is never taken for a menu or a notice; navigation, footers, forms and the like are never in it. Names of
classes are weaker: the name of a widget counts only where the slots don't hold prose.

A host's wrapper is inferred from all its pages: every task merges those it reads, the tasks' wrappers are merged in groups
of a host's, and those by host. Which texts come again is then counted over all pages: the wrapper says at which place a text
stands, and every text of a place is known by the least and the greatest hash of the contents that it stands with. Its size follows the number of different layouts, not of pages. Which of two equally good
alignments is taken depends on the order of merges. All pages are extracted from their whole html.
Pages aren't shuffled, hashes of their texts are, while the wrappers together are within `held_bytes`; beyond it they are joined by host, a join
whose skewed hosts Spark splits.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import extended, materialise, set_aside

#: Pages a template's text stands on, bytes of wrappers that tasks hold, levels of tags that wrappers tell apart.
SEVERAL, HELD_BYTES, DEPTH = 3, 32 << 20, 120
#: Parts of a sequence beyond which it is a repeated group of optional parts, kinds of parts in such a group by their names.
PARTS, KINDS = 48, 256
#: Texts of places that a task counts before it hands them on.
COUNTED = 1 << 17
#: Hosts, pages and parts of wrappers (about a hundred bytes each) that a task merges before it hands the wrappers on; groups that a host's wrappers are merged in first.
HOSTS, PAGES, HELD_PARTS, GROUPS = 4096, 1 << 17, 1 << 20, 32

# How HTML nests, and what is never main text.
BLOCKS = frozenset("address article aside blockquote body button canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html iframe li main menu nav noscript object ol option optgroup p pre script section select style summary svg table tbody td template textarea tfoot th thead title tr ul video audio".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "iframe", "noscript", "template", "svg", "object", "select"))
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}}
OUT_TAGS = frozenset("head title script style noscript template iframe svg object canvas video audio nav footer aside form button select textarea dialog menu".split())
OUT_ROLES = frozenset("@navigation @banner @contentinfo @complementary @search @alert @dialog @form".split())
CONTAINERS = frozenset("html body div section main article center table tbody tr td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Names of parts that hold prose which isn't the article's, names of widgets, and words that such names are composed with.
APART = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr newsletter subscribe signup comment comments disqus replies respond related recommended recommendations sidebar aside popup modal overlay notice notices alert hidden".split())
WIDGET = frozenset("share sharing social nav navbar navigation menu banner toolbar breadcrumb breadcrumbs pagination pager skip header footer masthead legal copyright widget login search side".split())
FILLER = frozenset("a area bar block body bottom bound box button buttons container content form global group inner item items left link links list main outer page panel post posts reader right row section side site slot small stories text the thread title top unit user wrap wrapper".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

#: Signatures of a text, of a repeated group without a tag of its own, and of one whose parts come in any order.
TEXT, GROUP, LOOSE = "#", "+", "*"


class Node:
    """An element of a page: its signature, its children."""

    __slots__ = ("sig", "kids")

    def __init__(self, sig: str):
        self.sig, self.kids = sig, []


class Text:
    """A text between block tags: white space and references as they stand, `words` with both resolved; how much of it is in links."""

    __slots__ = ("raw", "linked", "words")

    def __init__(self):
        self.raw, self.linked, self.words = [], 0, ""


def signature(tag: str, attributes: str) -> str:
    """tag, then what its class, id and role say; '!' marks hidden elements."""
    names, hidden = [], False
    for name, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
        elif name in ("class", "id") and not value.isdigit():
            names += re.sub(r"\d+", "", value).split()
        elif name == "role":
            names.append(f"@{value.lower()}")
    return ("!" if hidden else "") + ".".join([tag, *sorted({n.replace(".", "") for n in names})])


def tag_of(sig: str) -> str:
    return sig.lstrip("!").split(".", 1)[0]


def unnamed(sig: str) -> str:
    return "!" * (sig[0] == "!") + tag_of(sig)


def clean(s: str) -> str:
    return " ".join(html.unescape(s).split())


def parse(page: str) -> Node:
    """The tree of a page's block elements; inline tags vanish, a line break is white space.

    Elements below DEPTH levels become children of the element at that level, but what is inside one that is never
    main text stays in it.
    """
    root = Node("root")
    stack, at, linked = [(root, "root")], 0, False
    texts: list[Text] = []

    def text(s: str) -> None:
        kids = stack[-1][0].kids
        if not kids or not isinstance(kids[-1], Text):
            if not s or s.isspace():
                return
            kids.append(Text())
            texts.append(kids[-1])
        kids[-1].raw.append(s)
        if linked:
            kids[-1].linked += len(s.strip())

    while m := _TAG.search(page, at):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        end = m[1] or m[4]
        if tag == "a":
            linked = not end
            continue
        if tag in ("br", "hr") or tag not in BLOCKS:
            if tag in ("br", "hr"):
                text(" ")
            continue
        if end:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][1] == tag:
                    del stack[k:]
                    break
            else:
                text(" ")
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW:
            closing = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            stack[-1][0].kids.append(Node(signature(tag, attributes)))
            at = len(page) if closing is None and tag in ("script", "style") else closing.end() if closing else at
            continue
        closes, scope = CLOSES.get(tag, ()), SCOPES.get(tag, ())
        if stack[-1][1] == "p":
            stack.pop()
        for k in range(len(stack) - 1, 0, -1):
            name = stack[k][1]
            if name in scope:
                break
            if name in closes:
                del stack[k:]
                break
        if len(stack) > DEPTH and never(stack[-1][0].sig):
            text(" ")
            stack.append((stack[-1][0], tag))
            continue
        node = Node(signature(tag, attributes))
        stack[min(len(stack), DEPTH) - 1][0].kids.append(node)
        stack.append((node, tag))
    text(page[at:])
    for t in texts:
        t.words = clean("".join(t.raw))
        t.raw = None
    return root


# A wrapper's part: [signature, children, repeated, optional]. A text's children are its constant text (None: a slot), and it
# also has the contents of the pages that its constant stands on, the SEVERAL least of them, and what its texts
# are like: [number, characters, of these in links, words, ends of sentences].


def text_hash(words: str) -> int:
    return xxhash.xxh32_intdigest(words.encode("utf-8", "surrogatepass"))


def content_of(tree: Node) -> tuple[int, int]:
    """What tells a page's content: the hashes of its longest text and of the next, by words that aren't in links; of what is never main text only if there is nothing else."""
    best: list[list[tuple[int, int]]] = [[], []]  # elsewhere, in what is never main text
    todo = [(tree, False)]
    while todo:
        k, gone = todo.pop()
        if isinstance(k, Text):
            n = len(k.words) - min(k.linked, len(k.words))
            if k.words and (len(best[gone]) < 2 or n >= best[gone][-1][0]) and (own := (n, text_hash(k.words))) not in best[gone]:
                best[gone] = sorted([*best[gone], own], reverse=True)[:2]
        else:
            gone = gone or never(k.sig) or apart(k.sig)
            todo += [(x, gone) for x in k.kids]
    first, second = ([h for _, h in best[0] + best[1]] + [0, 0])[:2]
    return first, second


def content_beside(h: int, content: tuple[int, int]) -> int:
    """What a page of this content has besides the text of hash h."""
    return content[1] if h == content[0] else content[0]


def wrapper_of(tree: Node) -> list:
    return _wrapper_of(tree, content_of(tree))


def _wrapper_of(node: Node, content: tuple[int, int]) -> list:
    kids = []
    for k in node.kids:
        if isinstance(k, Node):
            kids.append(_wrapper_of(k, content))
        elif w := k.words:
            page = content_beside(text_hash(w), content)
            like = [1, len(w), min(k.linked, len(w)), w.count(" ") + 1, int(w[-1] in ".!?:;…。！？\"'”)")]
            kids.append([TEXT, w, False, False, [page], like])
    return [node.sig, fold(kids), False, False]


def _alike(a: list, b: list) -> list:
    """What the texts of two parts together are like."""
    return [x + y for x, y in zip(a, b)]


def _merged(a: list, b: list, beside: bool) -> list:
    """Two parts of one signature as one: side by side in one page (a repeated group), or the same place of two."""
    optional = (a[3] and b[3]) if beside else (a[3] or b[3])
    if a[0] == TEXT:
        if a[1] != b[1] or beside:
            return [TEXT, None, False, optional, [], _alike(a[5], b[5])]
        return [TEXT, a[1], False, optional, a[4] if a[4] == b[4] else sorted({*a[4], *b[4]})[:SEVERAL], _alike(a[5], b[5])]
    return [a[0], aligned(a[1], b[1]), a[2] or b[2] or beside, optional]


def loose(parts: list) -> list:
    """A repeated group of optional parts, one of each kind: what parts of any order and number match."""
    flat = list(chain.from_iterable(p[1] if p[0] in (GROUP, LOOSE) else [p] for p in parts))
    if len({p[0] for p in flat}) > KINDS:
        flat = [[p[0] if p[0] in (TEXT, GROUP, LOOSE) else unnamed(p[0]), *p[1:]] for p in flat]
    kinds: dict[str, list] = {}
    for p in flat:
        kinds[p[0]] = _optional(_merged(kinds[p[0]], p, True) if p[0] in kinds else p)
    return [LOOSE, [kinds[k] for k in sorted(kinds)], True, False]


def fold(kids: list) -> list:
    """Neighbours of one signature become a repeated group; so do tandem runs of two or three kinds, and long mixed runs."""
    out: list = []
    for k in kids:
        if out and out[-1][0] == k[0]:
            out[-1] = _merged(out[-1], k, True)
        else:
            out.append(k)
    for period in (2, 3):
        i = 0
        while i + 2 * period <= len(out):
            a, b = out[i : i + period], out[i + period : i + 2 * period]
            kinds = [x[0] for x in a]
            if GROUP not in kinds and LOOSE not in kinds and kinds == [x[0] for x in b]:
                group = [GROUP, [_merged(x, y, False) for x, y in zip(a, b)], True, False]
                j = i + 2 * period
                while [x[0] for x in out[j : j + period]] == kinds:
                    group[1] = [_merged(x, y, False) for x, y in zip(group[1], out[j : j + period])]
                    j += period
                out[i:j] = [group]
            i += 1
    return out if len(out) <= PARTS else [loose(out)]


def aligned(x: list, y: list) -> list:
    """Two sequences of parts as one, by their longest common subsequence; what one lacks becomes optional."""
    if [k[0] for k in x] == [k[0] for k in y]:
        return [_merged(a, b, False) for a, b in zip(x, y)]
    if any(k[0] == LOOSE for k in chain(x, y)):
        return [loose([*x, *y])]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i][0] == y[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i][0] == y[j][0]:
            out.append(_merged(x[i], y[j], False))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(_optional(x[i]))
            i += 1
        else:
            out.append(_optional(y[j]))
            j += 1
    return fold(out + [_optional(k) for k in (*x[i:], *y[j:])])


def _optional(part: list) -> list:
    return [*part[:3], True, *part[4:]]


def expression(wrapper: list) -> str:
    """The wrapper as a regular expression over a page's token stream."""
    if wrapper[0] == TEXT:
        return f"{TEXT}?" if wrapper[3] else TEXT
    parts = "".join(expression(k) for k in wrapper[1])
    body = parts if wrapper[0] in (GROUP, LOOSE) else f"<{re.escape(wrapper[0])}>{parts}</>"
    mark = {(True, True): "*", (True, False): "+", (False, True): "?"}.get((wrapper[2], wrapper[3]))
    return f"(?:{body}){mark}" if mark else body


def stream(node: Node) -> str:
    """A page's tokens in the alphabet of `expression`."""
    return f"<{node.sig}>{''.join(stream(k) if isinstance(k, Node) else TEXT if k.words else '' for k in node.kids)}</>"


class Role:
    """A place of a wrapper: the path of signatures to it (hashed), with what its own texts and those below it are like; of each seven numbers: the five of a
    part, how many different texts there are, and how many of these come again on pages of different content."""

    __slots__ = ("sig", "place", "kids", "fixed", "repeated", "own", "below", "out", "doubted", "mass")

    def __init__(self, sig: str, above: int = 0):
        self.sig, self.kids, self.fixed, self.repeated, self.own, self.below, self.out, self.doubted, self.mass = sig, {}, set(), False, [0] * 7, [0] * 7, False, False, 0.0
        self.place = xxhash.xxh3_64_intdigest(sig.encode("utf-8", "surrogatepass"), above) >> 1

    def kid(self, sig: str) -> Role | None:
        return self.kids.get(sig) or self.kids.get(unnamed(sig))

    def add(self, part: list, repeated: bool = False) -> None:
        """A child part of the wrapper."""
        if part[0] in (GROUP, LOOSE):
            for k in part[1]:
                self.add(k, True)
        elif part[0] == TEXT:
            if part[1] and len(part[4]) >= SEVERAL:
                self.fixed.add(part[1])
            for i, v in enumerate(part[5]):
                self.own[i] += v
        else:
            k = self.kids.setdefault(part[0], Role(part[0], self.place))
            k.repeated |= repeated or part[2]
            for x in part[1]:
                k.add(x)

    def sum_up(self, again: dict[int, tuple[int, int]]) -> None:
        """again: of places, how many different texts they have and how many of these come again."""
        self.own[5:] = again.get(self.place, (0, 0))
        self.below = list(self.own)
        for k in self.kids.values():
            k.sum_up(again)
            for i, v in enumerate(k.below):
                self.below[i] += v


def prose(like: list) -> bool:
    """Long texts, or sentences, that aren't links."""
    n, chars, linked, words, ends = like[:5]
    return n > 0 and 2 * linked < chars and (words >= 12 * n or 2 * ends >= n and words >= 6 * n)


def menu(like: list) -> bool:
    """Several short links."""
    n, chars, linked, words = like[:4]
    return n > 1 and 10 * linked >= 6 * chars and words < 8 * n


def worn(like: list) -> bool:
    """Texts that come again on pages of different content, nearly all of them."""
    return like[5] > 0 and 5 * like[6] >= 4 * like[5]


class Wrapper:
    """A host's wrapper with the number of pages behind it, which texts come again ([place, different texts, those that come again]), and the roles of its places."""

    def __init__(self, tree: list, pages: int, again: list[list[int]] | None = None):
        self.tree, self.pages, self.again = tree, pages, {place: (n, k) for place, n, k in again or ()}
        self._roots: dict[bool, Role] = {}
        self._places: list[Role] = []

    @staticmethod
    def infer(pages: list[str]) -> Wrapper:
        tree = None
        for p in pages:
            own = wrapper_of(parse(p))
            tree = own if tree is None else _merged(tree, own, False)
        bare, seen = Wrapper(tree or ["root", [], False, False], len(pages)), {}
        for p in pages:
            for place, h, content in bare.texts_of(parse(p)):
                seen.setdefault(place, {}).setdefault(h, set()).add(content)
        return Wrapper(bare.tree, bare.pages, [[place, len(own), sum(len(c) > 1 for c in own.values())] for place, own in seen.items()])

    def extended(self, page: Node) -> Wrapper:
        """With a page that isn't behind it: what comes again is as it was, and new places have nothing that does."""
        return Wrapper(_merged(self.tree, wrapper_of(page), False), self.pages + 1, [[place, *x] for place, x in self.again.items()])

    def texts_of(self, page: Node) -> Iterator[tuple[int, int, int]]:
        """(place, hash, what the page has besides) of each text of a page behind the wrapper."""
        if not self._places:
            self._places.append(Role("root"))
            for k in self.tree[1]:
                self._places[0].add(k)
        content, todo = content_of(page), [(page, self._places[0])]
        while todo:
            node, role = todo.pop()
            for k in node.kids:
                if isinstance(k, Text):
                    if k.words:
                        yield role.place, xxhash.xxh3_64_intdigest(k.words.encode("utf-8", "surrogatepass")) >> 1, content_beside(text_hash(k.words), content)
                elif (r := role.kid(k.sig)) is not None:
                    todo.append((k, r))

    def matches(self, tokens: str) -> bool:
        """Whether a page's token stream is one of the expression's."""
        return re.fullmatch(expression(self.tree), tokens) is not None

    def knows(self, page: Node) -> bool:
        """Whether the wrapper has a place for each of the page's elements."""
        todo = [(page, self.roles())]
        while todo:
            node, role = todo.pop()
            for k in node.kids:
                if isinstance(k, Node):
                    if (r := role.kid(k.sig)) is None:
                        return False
                    todo.append((k, r))
        return True

    def roles(self, again: bool = True) -> Role:
        """The places' roles; again: judged by what comes again, too."""
        if again not in self._roots:
            root = Role("root")
            for k in self.tree[1]:
                root.add(k)
            root.sum_up(self.again)
            plain = _judged(root, False, False)
            # Where pages are near copies of one another all comes again, and that says nothing.
            if again and _judged(root, False, True) < 0.1 * plain:
                _judged(root, False, False)
            self._roots[again] = root
        return self._roots[again]


def _judged(role: Role, within: bool, again: bool) -> float:
    """Sets what is out at this place and below, and what is doubted; gives the characters of new text there. again: count what comes again as old."""
    like, tag = role.below, tag_of(role.sig)
    doubt = doubtful(role.sig, within)
    role.out, role.doubted = never(role.sig) or apart(role.sig) or tag == "header" and not within, False
    if not role.out and tag not in ("root", "html", "body"):
        old, links = again and worn(like), menu(like)
        if doubt:
            role.out = old or links or not prose(like)
        elif is_article(role.sig):
            role.doubted = not within and (old or links)
        elif not within:
            role.out = role.doubted = old
            role.out |= links
            role.doubted &= not links
    within = within or is_article(role.sig)
    n, chars, linked = role.own[:3]
    fresh = 1 - role.own[6] / role.own[5] if again and role.own[5] else 1.0
    role.mass = (chars - linked) * fresh + sum(_judged(k, within, again) for k in role.kids.values())
    if role.out:
        role.mass = 0.0
    return role.mass


def is_article(sig: str) -> bool:
    tag, *names = sig.lstrip("!").split(".")
    return tag in ("article", "main") or "@main" in names or "@article" in names


@lru_cache(1 << 16)
def never(sig: str) -> bool:
    """Hidden, or by tag or role no main text."""
    tag, *names = sig.lstrip("!").split(".")
    return sig[0] == "!" or tag in OUT_TAGS or any(n in OUT_ROLES for n in names)


def _named(sig: str, words: frozenset) -> bool:
    """Whether a name is one of the words, alone or composed with fillers and each other: `comment-list`, not `social-science`."""
    tag, *names = sig.lstrip("!").split(".")
    if tag in ("root", "html", "body", "article", "main"):
        names = [n for n in names if n in ("comment", "ad", "promo")]  # a page's own classes say which kinds of parts it has
    for n in names:
        parts = [x for x in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", n) if x]
        parts = [x for p in parts for x in _words_in(p.lower())]
        if any(x in words for x in parts) and all(x in words or x in FILLER or x in APART or x in WIDGET for x in parts):
            return True
    return False


_NAMES = APART | WIDGET | FILLER


@lru_cache(1 << 16)
def _words_in(name: str) -> tuple[str, ...]:
    """A name without separators as the two known words that it is made of, if it is: `commentlist`."""
    if name not in _NAMES:
        for i in range(2, len(name) - 1):
            if name[:i] in _NAMES and name[i:] in _NAMES:
                return name[:i], name[i:]
    return (name,)


@lru_cache(1 << 16)
def apart(sig: str) -> bool:
    """By name an advert, a notice, readers' comments or the like."""
    return _named(sig, APART)


def doubtful(sig: str, within: bool) -> bool:
    """By name a widget, which its texts must confirm; an article's own header is part of it."""
    return _named(sig, WIDGET - {"header"} if within else WIDGET)


def extract(page: str, wrapper: Wrapper) -> str:
    """The main text of a page by its host's wrapper, which the page extends if it has places that the wrapper lacks."""
    tree = parse(page)
    if not wrapper.knows(tree):
        wrapper = wrapper.extended(tree)
    root = wrapper.roles()
    articles = list(_articles(tree, root))
    # The article element is the article if the host's pages have a fair part of their new text in such elements.
    main = [(n, r) for n, r in articles if not r.doubted]
    if main and sum({id(r): r.mass for _, r in main}.values()) >= 0.3 * _mass_of(tree, root):
        return " ".join(chain.from_iterable(_texts(n, r, False) for n, r in main))
    # Texts of link lists and of near copies are in doubt; where the page has no other article they are what it is about.
    if articles and not main and 10 * sum(_size(n) for n, _ in articles) >= 3 * _size(tree):
        return " ".join(chain.from_iterable(_texts(n, r, False) for n, r in articles))
    found = " ".join(_texts(*_region(tree, root), True))
    if 4 * len(found) < _doubted(tree, root):  # nearly all prose of this page comes again: it is one of near copies, and that says nothing
        found = " ".join(_texts(*_region(tree, wrapper.roles(False)), False))
    return found


def _size(node: Node) -> int:
    """Characters of a page's texts below a node, without what is never main text or apart by its name."""
    return sum(len(k.words) if isinstance(k, Text) else 0 if never(k.sig) or apart(k.sig) else _size(k) for k in node.kids)


def _doubted(node: Node, role: Role) -> int:
    """Characters of the page's texts that are out for the one reason that they come again."""
    return sum(_size(k) if r.out and r.doubted else 0 if r.out else _doubted(k, r) for k in node.kids if isinstance(k, Node) and (r := role.kid(k.sig)))


def _articles(node: Node, role: Role) -> Iterator[tuple[Node, Role]]:
    """The outermost article elements that aren't inside what is out."""
    for k in node.kids:
        if isinstance(k, Node):
            r = role.kid(k.sig)
            if is_article(k.sig) and not r.out:
                yield k, r
            elif not (never(k.sig) or apart(k.sig)):
                yield from _articles(k, r)


def _mass_of(node: Node, role: Role) -> float:
    """The new text that the host's pages have at the places this page has, article elements whole."""
    own = (role.own[1] - role.own[2]) if any(isinstance(k, Text) for k in node.kids) else 0
    kids = {id(r): (k, r) for k in node.kids if isinstance(k, Node) and not (r := role.kid(k.sig)).out}
    return min(role.mass, own + sum(r.mass if is_article(k.sig) else _mass_of(k, r) for k, r in kids.values()))


def _region(node: Node, role: Role) -> tuple[Node, Role]:
    """The smallest container with the new text: what it leaves beside itself are scraps, no prose and no headings."""
    while True:
        kids = [(k, r) for k in node.kids if isinstance(k, Node) and not (r := role.kid(k.sig)).out]
        total = sum({id(r): r.mass for _, r in kids}.values())
        best = max(kids, key=lambda x: x[1].mass, default=None)
        if best is None or tag_of(best[0].sig) not in CONTAINERS or best[1].repeated or best[1].mass < 0.8 * total or sum(r is best[1] for _, r in kids) > 1:
            return node, role
        rest = [r for _, r in kids if r is not best[1] and r.mass > 0]
        if any(prose(r.below) or tag_of(r.sig) in HEADINGS for r in rest) or any(isinstance(k, Text) and k.words and k.words not in role.fixed for k in node.kids):
            return node, role
        node, role = best


def _texts(node: Node, role: Role, template_goes: bool) -> Iterator[str]:
    """The texts below a node in page order, without what is out; of what the template has only an article's."""
    todo = [(node, role)]
    while todo:
        k, r = todo.pop()
        if isinstance(k, Text):
            if k.words and not (template_goes and k.words in r.fixed):
                yield k.words
        elif not r.out or k is node:
            todo += [(x, r.kid(x.sig) if isinstance(x, Node) else r) for x in reversed(k.kids)]


def host() -> Column:
    """The host of url, null without one."""
    name = F.lower(F.regexp_replace(F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[/?#].*$", ""))
    return F.nullif(name, F.lit(""))


def parts_of(wrapper: list) -> int:
    """How many parts a wrapper has."""
    n, todo = 0, [wrapper]
    while todo:
        part = todo.pop()
        n += 1
        if part[0] != TEXT:
            todo += part[1]
    return n


def host_wrappers(pages: DataFrame, hosts: int = HOSTS, held_parts: int = HELD_PARTS, groups: int = GROUPS) -> DataFrame:
    """(host, wrapper): JSON of each host's wrapper, from all its pages; a task merges equal pages of a host once. Pages without a host have none.

    A host of very many pages has a partial wrapper of each task; these are merged in `groups` of them first, so that none meets more than its share.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        parts: dict[str, int] = {}
        seen: set[int] = set()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())], ["host", "wrapper"])
            held.clear()
            parts.clear()
            seen.clear()
            return rows

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part, grown = b.slice(lo, 256), set()
                for h, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    key = xxhash.xxh3_64_intdigest(f"{h}\n{page}".encode("utf-8", "surrogatepass"))
                    if h in held and key in seen:
                        continue
                    seen.add(key)
                    own = wrapper_of(parse(page))
                    held[h] = [_merged(held[h][0], own, False), held[h][1] + 1] if h in held else [own, 1]
                    grown.add(h)
                parts.update((h, parts_of(held[h][0])) for h in grown)
                if len(held) >= hosts or len(seen) >= PAGES or sum(parts.values()) >= held_parts:
                    yield out()
        if held:
            yield out()

    def merge(part: pa.Table) -> pa.Table:
        tree, n = None, 0
        for text in sorted(part.column("wrapper").to_pylist()):
            own, k = json.loads(text)
            tree, n = own if tree is None else _merged(tree, own, False), n + k
        return pa.table({"host": part.column("host")[:1], "wrapper": pa.array([json.dumps([tree, n])], pa.string())})

    parts = pages.select(host().alias("host"), F.coalesce("html", F.lit("")).alias("html")).where(F.col("host").isNotNull()).mapInArrow(partial, "host string, wrapper string")
    some = parts.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(groups)).alias("salt")).applyInArrow(merge, "host string, wrapper string")
    return some.groupBy("host").applyInArrow(merge, "host string, wrapper string")


def extract_pages(pages: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """pages without html, with text string: the main text, empty if there is none.

    A null or empty html gives an empty text; a page with a null url, or one that names no host, has a wrapper of its own alone; repeated pages
    are extracted each for itself; near copies of a page on one host (another advert, another query in the url) give what each gives alone; extra columns pass, a column named text is replaced.
    """
    pages, back = set_aside(pages.drop("text"), "_host", "_wrapper", "host")
    found = materialise(host_wrappers(pages), "wrappers")
    wrappers = materialise(_counted(pages, found, held_bytes), "counted")
    keep = [c for c in pages.columns if c != "html"]
    rows, wrapper_of_row = _beside_wrappers(pages.select(*keep, "html", host().alias("_host")), wrappers, held_bytes)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wrapper_of_row()
        for b in batches:
            texts = [extract(p.as_py() or "", w) for p, w in zip(b.column(n), known(b))]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(texts, pa.string())], [*keep, "text"])

    return rows.mapInArrow(run, extended(pages.select(*keep).schema, "text string")).withColumnsRenamed(back)


def _beside_wrappers(rows: DataFrame, wrappers: DataFrame, held_bytes: int) -> tuple[DataFrame, Callable]:
    """rows (..., _host), with _wrapper behind it if the wrappers together are too large to be held; and what gives a task the function from batches of them to each row's wrapper."""
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    at, held = rows.columns.index("_host"), None
    if size <= held_bytes:
        held = rows.sparkSession.sparkContext.broadcast({r.host: r.wrapper for r in wrappers.toLocalIterator()})
    else:
        rows = rows.join(wrappers.withColumnRenamed("wrapper", "_wrapper"), F.col("_host") == F.col("host"), "left").drop("host")

    def start() -> Callable:
        loaded: dict[str, Wrapper] = {}

        def wrapper(host: str | None, text: str | None) -> Wrapper:
            if host not in loaded:
                if len(loaded) >= 4096:
                    loaded.clear()
                loaded[host] = Wrapper(*(json.loads(text) if text else (["root", [], False, False], 0)))
            return loaded[host]

        def known(b: pa.RecordBatch) -> Iterator[Wrapper]:
            hosts = b.column(at).to_pylist()
            forms = (held.value.get(h) for h in hosts) if held else (x.as_py() for x in b.column(at + 1))
            return map(wrapper, hosts, forms)

        return known

    return rows, start


def _counted(pages: DataFrame, wrappers: DataFrame, held_bytes: int, counted: int = COUNTED) -> DataFrame:
    """wrappers (host, wrapper) that also say which texts come again, as Wrapper takes it: exactly, over all texts of all pages.

    A text at a place comes again if the pages it stands on differ in content, which the least and the greatest of their contents' hashes tell.
    """
    own = pages.select(F.coalesce("html", F.lit("")).alias("html"), host().alias("_host")).where(F.col("_host").isNotNull()).select("html", F.xxhash64("_host").alias("key"), "_host")
    rows, wrapper_of_row = _beside_wrappers(own, wrappers, held_bytes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = wrapper_of_row(), {}

        def out() -> pa.RecordBatch:
            columns = [*zip(*seen), *zip(*seen.values())]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "place", "text", "least", "most"])

        for b in batches:
            for page, key, w in zip(b.column(0), b.column(1).to_pylist(), known(b)):
                for place, h, content in w.texts_of(parse(page.as_py())):
                    least, most = seen.get((key, place, h), (content, content))
                    seen[key, place, h] = min(least, content), max(most, content)
                if len(seen) >= counted:
                    yield out()
        if seen:
            yield out()

    texts = rows.mapInArrow(count, "key bigint, place bigint, text bigint, least bigint, most bigint")
    each = texts.groupBy("key", "place", "text").agg((F.min("least") < F.max("most")).alias("again"))
    places = each.groupBy("key", "place").agg(F.count(F.lit(1)).alias("n"), F.count_if("again").alias("k"))
    listed = places.groupBy("key").agg(F.to_json(F.array_sort(F.collect_list(F.array("place", "n", "k")))).alias("again"))
    both = wrappers.join(listed, F.xxhash64("host") == F.col("key"), "left")
    return both.select("host", F.concat(F.expr("left(wrapper, length(wrapper) - 1)"), F.lit(", "), F.coalesce("again", F.lit("[]")), F.lit("]")).alias("wrapper"))
