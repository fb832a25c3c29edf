"""HTML main-text extraction by wrapper induction.

Pages of one host share a template.  Every page is parsed and its DOM tree reduced to a schema (siblings with
the same tag and classes become one node).  The schemas of all pages of a host are laid over each other by the
paths of their labels, with counts per node, and every page is aligned with the result by simple tree
matching, the ordered matching of two trees with most node pairs.  Nodes whose text is the same on all pages that
have them belong to the template, as do
blocks that a set share of the host's pages repeat; nodes whose text varies are content slots.  The wrapper is the schema with the lowest node that holds all varying slots, the content container, marked.
Pages with main or article elements make a wrapper of their own, where
these are the containers: main elements if there are any, else the articles but those
that are mostly links.  The text below the containers that a page's alignment reaches is taken, block by block; a page
that does not align is its own reference.  No page is left out of the counts.

What is boilerplate whatever it says: elements that HTML or ARIA define as such
(nav, footer, aside, form, ..., their roles, hidden ones), and reader comments by
the names they go by.  Class and id names such as `share-box` or `ad` are evidence
only: outside article and main they keep an element from being a slot, inside
an element so named goes if it is mostly links too or says what such elements say on that share of the host's pages.
"""

from __future__ import annotations

import hashlib
import html as _html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Tuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import col, cut, pieces


@dataclass(frozen=True)
class WrapperParams:
    """enough: pages that must agree before a text that never varies counts as template.  common: share of all
    pages of a host that must have a block for it to be left out.  rare: a node on a smaller share of the
    pages of a host and kind is no node of its wrapper (its text makes its parent vary), which bounds a wrapper by the nodes of
    1 / rare pages.  held: counts a task holds before it hands them on.  broadcast_hosts: most hosts whose
    wrappers (a few KB each) are broadcast; beyond, a salted join.  references, broadcast_references: without
    effect since all pages are references."""
    references: int = 8
    enough: int = 3
    common: float = 0.5
    rare: float = 0.01
    held: int = 100_000
    broadcast_hosts: int = 5000
    broadcast_references: int = 200_000
    salts: int = 16


# ------------------------------------------------------------------ parsing
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?+"
                    r"|<(/?+)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
                    r"|<(/?+)([a-zA-Z][^\s/>]*+)([^>]*+)>|</?+[a-zA-Z][^>]*+\Z", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                   "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
                   "nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
_CLOSES_P = _BLOCK - frozenset("option tbody td tfoot th thead tr caption html head body title legend".split())
_HOLDS = (_CLOSES_P | {"html", "body"}) - frozenset("p li dt dd pre h1 h2 h3 h4 h5 h6".split())
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
             "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"),
             "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "body": ("head",)}
_SCOPE = frozenset("html body table td th ul ol dl article section div main button object form aside nav header "
                   "footer blockquote figure".split())
_DROP = frozenset("script style noscript template nav footer aside form button select option textarea iframe svg "
                  "object canvas dialog menu head title audio video math".split())
_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar "
                  "toolbar".split())
# Words of class and id names for what stands beside the text, the words
# that may go with them, and names of reader comments.
_BESIDE = frozenset("ad ads advert adverts advertisement advertising adsense banner banners sponsor sponsored sponsors promo promos "
                    "promotion cookie cookies consent gdpr notice notices alert alerts popup modal newsletter subscribe subscription "
                    "sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs masthead footer header "
                    "related recommended share sharing social login signup search toolbar pagination pager skip".split())
_WITH = frozenset("area bar block bottom box button buttons container content form group icon icons inner item items left link links list "
                  "main outer page panel primary right row secondary section site slot to top unit wrap wrapper".split())
_COMMENTS = frozenset("comments comment commentlist comment-list comments-area comments-section disqus disqus_thread respond "
                      "replies".split())
_MAIN = frozenset(("article", "main"))
_DEEPEST = 200
_NAMED = r"(?i)<(?:main|article)[\s/>]|role\s*=\s*[\"']?main\b|itemprop\s*=\s*[\"']?articlebody\b"


class Node:
    __slots__ = ("tag", "label", "noise", "hint", "main", "kids", "up", "depth")

    def __init__(self, tag: str, attrs: str, up: "Node | None"):
        self.tag, self.up, self.kids = tag, up, []
        self.depth = up.depth + 1 if up is not None else 0
        names = {}
        if attrs and "=" in attrs or "hidden" in attrs:
            for k, v in _ATTR.findall(attrs):
                names.setdefault(k.lower(), v.strip("\"'"))
        classes = " ".join(sorted(names.get("class", "").lower().split()))
        self.label = f"{tag}.{classes}" if classes else tag
        role = names.get("role", "").lower()
        self.main = tag in _MAIN or role == "main" or names.get("itemprop", "").lower() == "articlebody"
        self.noise = tag in _DROP or role in _ROLE or "hidden" in names or names.get("aria-hidden") == "true" or (
            tag == "header" and not _inside_main(up))
        self.hint = False
        own = [*classes.split(), *names.get("id", "").lower().split()]
        if own and not self.noise and not self.main and tag not in ("html", "body"):
            self.noise = any(t in _COMMENTS for t in own)
            if not self.noise and any(map(_beside, own)):
                self.hint = _inside_main(up)
                self.noise = not self.hint


def _beside(name: str) -> bool:
    """Whether all words of a class or id name speak of what stands beside the text, as in `share-box`, not `share-price`."""
    parts = [p for p in re.split(r"[-_]+|\d+", name) if p]
    return any(p in _BESIDE for p in parts) and all(p in _BESIDE or p in _WITH for p in parts)


def _letters(node: "Node") -> tuple[int, int]:
    """Characters without white space below a node, and those of them in links."""
    total = linked = 0
    stack = [(node, False)]
    while stack:
        n, inside = stack.pop()
        for k in n.kids:
            if isinstance(k, str):
                size = len("".join(k.split()))
                total += size
                linked += size * inside
            elif not k.noise:
                stack.append((k, inside or k.tag == "a"))
    return total, linked


def _mostly_links(node: "Node") -> bool:
    total, linked = _letters(node)
    return linked > 0 and 2 * linked >= total


def _inside_main(node: "Node | None") -> bool:
    while node is not None:
        if node.main:
            return True
        node = node.up
    return False


def parse(page: str) -> Node:
    """DOM of a page: elements and, as strings, undecoded text.  Unclosed and
    unmatched tags are tolerated, an unfinished tag at the end is dropped.
    Elements nested deeper than _DEEPEST stay on that level; text in those of them
    that are boilerplate is left out there and then."""
    root = at = Node("#root", "", None)
    deep: list[tuple[str, bool]] = []                   # elements open beyond the deepest level: tag, boilerplate
    muted = 0
    pos = 0
    low = None
    for m in _TOKEN.finditer(page):
        if m.start() < pos:
            continue
        if m.start() > pos and not muted:
            at.kids.append(page[pos:m.start()])
        pos = m.end()
        name = m.group(2) or m.group(5)
        if not name:
            continue
        tag = name.lower()
        if m.group(1) or m.group(4):
            if deep:
                last = next((k for k in range(len(deep) - 1, -1, -1) if deep[k][0] == tag), None)
                if last is not None:
                    muted -= sum(noise for _, noise in deep[last:])
                    del deep[last:]
                    at.kids.append(Node("br", "", at))
                    continue
            node = at
            while node is not None and node.tag != tag:
                node = node.up
            if node is not None and node.up is not None:
                at, muted = node.up, 0
                deep.clear()
            elif tag in ("p", "br"):
                at.kids.append(Node(tag, "", at))
            continue
        attrs = m.group(3) or m.group(6) or ""
        if not deep:
            if tag in _CLOSES_P:
                at = _close(at, ("p",))
            if tag in _SIBLINGS:
                at = _close(at, _SIBLINGS[tag], _SIBLINGS[tag])
        node = Node(tag, attrs, at)
        if not muted:
            at.kids.append(node)
        if tag in _RAW:
            low = page.lower() if low is None and len(page.lower()) == len(page) else low or page
            end = low.find("</" + tag, pos)
            end = len(page) if end < 0 else end
            if tag in ("title", "textarea"):
                node.kids.append(page[pos:end])
            close = page.find(">", end)
            pos = len(page) if close < 0 else close + 1
        elif tag not in _VOID and not attrs.endswith("/"):
            if node.depth < _DEEPEST:
                at = node
            else:
                deep.append((tag, node.noise))
                muted += node.noise
    if pos < len(page) and not muted:
        at.kids.append(page[pos:])
    return root


def _close(at: Node, tags: tuple, through: tuple = ()) -> Node:
    """Leave the innermost open element of `tags` that no scope boundary shields."""
    node = at
    while node is not None and node.up is not None:
        if node.tag in tags:
            top = node
            while top.up is not None and top.up.tag in through:
                top = top.up
            return top.up
        if node.tag in _SCOPE:
            return at
        node = node.up
    return at


def _code(text: str) -> int:
    """Digest of a text, 0 for none."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True) if text else 0


def blocks(node: Node, skip=None, said: frozenset = frozenset()) -> list[str]:
    """Text blocks below a node in page order: boilerplate left out, references
    decoded, white space runs as one space, ends trimmed, empty blocks and those whose digests are in `skip` dropped.  An
    element named like what stands beside the text goes if it is mostly links or says one of `said`."""
    out: list[str] = []
    line: list[str] = []

    def flush():
        text = " ".join(_html.unescape("".join(line)).split())
        line.clear()
        if text and not (skip and _code(text) in skip):
            out.append(text)

    stack: list[tuple] = [(node, iter(node.kids), False)]
    while stack:
        top, kids, is_block = stack[-1]
        for kid in kids:
            if isinstance(kid, str):
                line.append(kid)
            elif kid.noise or kid.hint and (_mostly_links(kid) or said and _says(kid) in said):
                if kid.tag in _BLOCK or kid.tag in _DROP:
                    flush()
            elif kid.tag == "br":
                line.append(" ")
            else:
                block = kid.tag in _BLOCK
                if block:
                    flush()
                stack.append((kid, iter(kid.kids), block))
                break
        else:
            if is_block or len(stack) == 1:
                flush()
            stack.pop()
    return out


def _says(node: Node) -> int:
    """Digest of the text of an element."""
    return _code(" ".join(blocks(node)))


# ------------------------------------------------------- schemas and matching
@dataclass
class Slot:
    """A schema node: label, how many reference pages have it, a digest of the
    text right below it that all of them share (None: it varies), the mean
    length of that text, and its children."""
    label: str
    support: int = 1
    text: int | None = 0
    chars: float = 0.0
    main: bool = False
    kids: list["Slot"] = field(default_factory=list)

    def pack(self) -> list:
        return [self.label, self.support, self.text, self.chars, self.main, [k.pack() for k in self.kids]]

    @staticmethod
    def unpack(x: list) -> "Slot":
        return Slot(*x[:5], [Slot.unpack(k) for k in x[5]])


def schema(nodes: list[Node], label: str = "#root") -> Slot:
    """Schema of DOM nodes that share a label; boilerplate elements are left out."""
    groups: dict[str, list[Node]] = {}
    text: list[str] = []
    for n in nodes:
        for kid in n.kids:
            if isinstance(kid, str):
                text.append(kid)
            elif not kid.noise:
                groups.setdefault(kid.label, []).append(kid)
    own = " ".join(_html.unescape(" ".join(text)).split())
    return Slot(label, 1, _code(own), float(len(own)), any(n.main for n in nodes),
                [schema(v, k) for k, v in groups.items()])


def _simple(tag_label: str) -> str:
    return tag_label.split(".", 1)[0]


def match(a: Slot, b: Slot) -> tuple[int, list[tuple[Slot, Slot]]]:
    """Simple tree matching: the largest ordered matching of two trees that maps
    roots to roots and children to children, as its size and node pairs.  Children
    whose labels are unique on both sides, as in schemas, are matched in
    k log k steps for k common labels, others by a table."""
    if a.label != b.label:
        return 0, []
    left, right = [k.label for k in a.kids], [k.label for k in b.kids]
    if len(set(left)) == len(left) and len(set(right)) == len(right):
        pairs = _heaviest(a.kids, b.kids)
    else:
        pairs = _by_table(a.kids, b.kids)
    return 1 + sum(n for n, _ in pairs), [(a, b), *(p for _, found in pairs for p in found)]


def _heaviest(left: list[Slot], right: list[Slot]) -> list[tuple]:
    """Matches of equal labels in the order of both lists, of greatest total size: a heaviest increasing subsequence,
    by prefix maxima over the places of the right list."""
    place = {k.label: j for j, k in enumerate(right, start=1)}
    common = [(place[x.label], match(x, right[place[x.label] - 1])) for x in left if x.label in place]
    best = [(0, -1)] * (len(right) + 1)                  # of prefixes, as a Fenwick tree: weight, last match
    before: list[int] = []
    total: list[int] = []
    for k, (j, found) in enumerate(common):
        q, top = j - 1, (0, -1)
        while q:
            top = max(top, best[q])
            q -= q & -q
        before.append(top[1])
        total.append(top[0] + found[0])
        q = j
        while q <= len(right):
            best[q] = max(best[q], (total[k], k))
            q += q & -q
    k = max(range(len(common)), key=total.__getitem__, default=-1)
    out = []
    while k >= 0:
        out.append(common[k][1])
        k = before[k]
    return out[::-1]


def _by_table(left: list[Slot], right: list[Slot]) -> list[tuple]:
    m, n = len(left), len(right)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    got: dict[tuple[int, int], tuple] = {}
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            if left[i - 1].label == right[j - 1].label:
                got[i, j] = match(left[i - 1], right[j - 1])
            w = got.get((i, j), (0,))[0]
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + w)
    out, i, j = [], m, n
    while i and j:
        w = got.get((i, j), (0,))[0]
        if w and best[i][j] == best[i - 1][j - 1] + w:
            out.append(got[i, j])
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


#: What an observation counts: pages, schema nodes, text blocks, what hinted elements say.
_PAGE, _NODE, _BLOCK_OF, _SAID = range(4)
#: Sums of an observation: pages with it, characters right below, characters below, place among its siblings, pages where it is a
#: main element.
_SUMS = 5


def observe(page: str) -> Iterator[tuple]:
    """What a page adds to the counts of its host, as (kind, what, id, up, label, sums, digest): the page, every node of its
    schema (id and up are digests of label paths), and its distinct blocks or, on pages with main or article elements, what
    elements named like boilerplate inside these say."""
    tree = parse(page)
    mains = _mains(tree)
    kind = bool(mains)
    yield kind, _PAGE, 0, 0, "", (1, 0, 0, 0, 0), 0
    at = {tuple(_path_of(n)) for n in mains}
    out: list[tuple] = []

    def walk(s: Slot, path: tuple, id_: int, up: int, place: int) -> int:
        mine = len(out)
        out.append(())
        below = int(s.chars)
        for k, kid in enumerate(s.kids):
            below += walk(kid, (*path, kid.label), _code(f"{id_} {kid.label}"), id_, 1_000_000 * k // max(len(s.kids) - 1, 1))
        out[mine] = kind, _NODE, id_, up, s.label, (1, int(s.chars), below, place, int(kind and path in at)), s.text
        return below
    walk(schema([tree]), (), 1, 0, 0)
    yield from out
    if kind:
        told, what = {_says(n) for m in mains for n in _hinted(m)}, _SAID
    else:
        told, what = {_code(b) for b in blocks(tree)}, _BLOCK_OF
    for d in told:
        yield kind, what, d, 0, "", (1, 0, 0, 0, 0), 0


def _add(counts: dict, key: tuple, sums: tuple, digest: int) -> None:
    """Add an observation to counts: key -> [sums..., least digest, greatest digest]."""
    got = counts.get(key)
    if got is None:
        counts[key] = [*sums, digest, digest]
    else:
        for j in range(_SUMS):
            got[j] += sums[j]
        got[-2], got[-1] = min(got[-2], digest), max(got[-1], digest)


def induce(pages: list[str], params: WrapperParams = WrapperParams()) -> dict:
    """Wrapper of a host from all its pages: see `wrapper_of`."""
    counts: dict = {}
    for p in pages:
        for kind, what, id_, up, label, sums, digest in observe(p):
            _add(counts, (kind, what, id_, up, label), sums, digest)
    return wrapper_of(counts, params)


def wrapper_of(counts: dict, params: WrapperParams = WrapperParams()) -> dict:
    """The wrapper by the counts over all pages of a host: the schema of those without main or article
    elements, the path of their content container, digests of the template blocks (skip); and `mains`, the wrapper of
    those with such elements: their schema, the paths of these, and digests of what elements named like boilerplate inside them say
    on `common` of the pages.  Counts that `_kept` drops may be missing."""
    n = {kind: c[0] for (kind, what, *_), c in counts.items() if what == _PAGE}
    often = {k: c for k, c in counts.items() if _kept(k[1], c[0], n[k[0]], params)}

    def found(kind, what):
        return sorted(k[2] for k in often if k[:2] == (kind, what))
    wrapper = {"path": [], "skip": [], "tree": None, "mains": None}
    if n.get(False):
        tree, _ = _tree(often, False)
        wrapper |= {"path": _container(tree, params), "skip": found(False, _BLOCK_OF), "tree": tree.pack()}
    if n.get(True):
        tree, paths = _tree(often, True)
        wrapper["mains"] = {"tree": tree.pack(), "paths": paths, "said": found(True, _SAID)}
    return wrapper


def _kept(what, n, pages, params: WrapperParams):
    """Whether what n of so many pages have counts for their wrapper."""
    if what == _BLOCK_OF:
        return pages >= 2 * params.enough and n >= params.common * pages
    if what == _SAID:
        return pages >= params.enough and n >= params.common * pages
    return n >= params.rare * pages


def _tree(counts: dict, kind: bool) -> tuple[Slot, list[list[str]]]:
    """The schema of the pages of a kind, siblings by their mean places, and the paths of main elements.  A node
    some of whose text is in nodes not kept varies."""
    kids: dict[int, list] = {}
    for (k, what, id_, up, label), c in counts.items():
        if k == kind and what == _NODE:
            kids.setdefault(up, []).append((c[3] / c[0], label, id_, c))
    paths: list[list[str]] = []

    def build(label: str, id_: int, c: list, path: list[str]) -> Slot:
        below = sorted(kids.get(id_, []), key=lambda k: k[:3])
        rest = c[2] - c[1] - sum(k[3][2] for k in below)
        if c[4]:
            paths.append(path)
        slot = Slot(label, c[0], c[5] if c[5] == c[6] and not rest else None, (c[1] + bool(rest)) / c[0], bool(c[4]))
        slot.kids = [build(lab, i, x, [*path, lab]) for _, lab, i, x in below]
        return slot
    _, label, id_, c = kids[0][0]
    return build(label, id_, c, []), sorted(paths)


def _hinted(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        n = stack.pop()
        if n.hint:
            yield n
        else:
            stack += [k for k in n.kids if isinstance(k, Node) and not k.noise]


def _path_of(node: Node) -> list[str]:
    path = []
    while node.up is not None:
        path.append(node.label)
        node = node.up
    return path[::-1]


def _container(wrapper: Slot, params: WrapperParams) -> list[str]:
    """Path of the lowest node that holds all varying slots."""
    def varying(s: Slot) -> float:
        constant = s.text is not None and s.support >= params.enough
        return (0.0 if constant else s.chars) * s.support + sum(map(varying, s.kids))

    def total(s: Slot) -> float:
        return s.chars * s.support + sum(map(total, s.kids))

    mass = varying if varying(wrapper) > 0 else total   # pages that are all alike have only constants
    path, node = [], wrapper
    while True:
        best = max(node.kids, key=mass, default=None)
        if best is None or mass(best) < mass(node) or mass(node) == 0 or _simple(best.label) not in _HOLDS:
            return path
        path.append(best.label)
        node = best


def _at_path(nodes: list[Node], path: list[str]) -> list[Node]:
    """DOM nodes at a path of labels, boilerplate not entered."""
    for label in path:
        nodes = [k for n in nodes for k in n.kids if isinstance(k, Node) and k.label == label and not k.noise]
    return nodes


def _mains(tree: Node) -> list[Node]:
    """Where a page says its text is: its outermost main elements, else its outermost articles but those that are
    mostly links beside others."""
    out, stack = [], [tree]
    while stack:
        n = stack.pop()
        if n.main:
            out.append(n)
        else:
            stack += [k for k in reversed(n.kids) if isinstance(k, Node) and not k.noise]
    strict = [n for n in out if n.tag != "article"]
    if strict:
        return strict
    own = [n for n in out if not _mostly_links(n)] if len(out) > 1 else out
    return own or out


def extract(page: str | None, wrapper: dict | None, params: WrapperParams = WrapperParams(),
            aligned: dict | None = None) -> str:
    """Main text of a page; see `extracted`."""
    return extracted(page, wrapper, params, aligned)[0]


def extracted(page: str | None, wrapper: dict | None, params: WrapperParams = WrapperParams(),
              aligned: dict | None = None) -> tuple[str, str]:
    """Main text of a page and where it comes from: wrapper, own (the page is its own reference) or none.

    The page's schema is aligned by simple tree matching with its host's wrapper of its
    kind, and the text is that of the nodes matched to containers.  A page whose
    alignment misses the containers, or whose main and article elements are not those of
    the wrapper, is its own reference, as is a page of a host without a wrapper.
    A page of template blocks only keeps them.
    """
    if not page:
        return "", "none"
    tree = parse(page)
    mains = _mains(tree)
    cache = aligned if aligned is not None else {}
    kind = wrapper.get("mains") if wrapper and mains else wrapper
    paths = None
    if kind and kind.get("tree"):
        own = _skeleton([tree])
        shape = bool(mains), _shape(own)
        if shape not in cache:
            if len(cache) > 10_000:
                cache.clear()
            cache[shape] = _aligned_paths(kind["tree"], kind["paths"] if mains else [kind["path"]], own)
        paths = cache[shape]
    if mains:
        said, via = frozenset(kind["said"]) if kind else frozenset(), "wrapper"
        nodes = _in_order(tree, paths) if paths else []
        if len(nodes) != len(mains) or any(a is not b for a, b in zip(nodes, mains)):
            nodes, via = mains, "own"
        return " ".join(b for n in nodes for b in blocks(n, None, said)), via
    skip, via = frozenset(wrapper["skip"]) if wrapper else frozenset(), "wrapper"
    if not paths:
        solo = induce([page], params)
        paths, skip, via = [solo["path"]], frozenset(), "own"
    nodes = _at_path([tree], paths[0])
    return " ".join(b for n in nodes for b in blocks(n, skip)) or " ".join(b for n in nodes for b in blocks(n)), via


def _skeleton(nodes: list[Node], label: str = "#root") -> Slot:
    """`schema` without the texts."""
    groups: dict[str, list[Node]] = {}
    for n in nodes:
        for kid in n.kids:
            if not isinstance(kid, str) and not kid.noise:
                groups.setdefault(kid.label, []).append(kid)
    return Slot(label, kids=[_skeleton(v, k) for k, v in groups.items()])


def _in_order(tree: Node, paths: list[list[str]]) -> list[Node]:
    """Nodes at any of the paths in page order, those that main elements or the kind's articles are."""
    found = {id(n) for p in paths for n in _at_path([tree], p)}
    return [n for n in _mains(tree) if id(n) in found]


def _shape(s: Slot) -> tuple:
    return s.label, tuple(map(_shape, s.kids))


def _aligned_paths(packed: list, paths: list[list[str]], own: Slot) -> list[list[str]]:
    """Those of the paths that the alignment maps to nodes of the page."""
    tree = Slot.unpack(packed)
    _, pairs = match(tree, own)
    mapped = {id(a) for a, _ in pairs}
    out = []
    for path in paths:
        node = tree
        for label in path:
            node = next((k for k in node.kids if k.label == label and id(k) in mapped), None)
            if node is None:
                break
        else:
            out.append(path)
    return out


# -------------------------------------------------------------------- Spark
def host_of(url: Column) -> Column:
    """Lower-cased host of a URL without port; empty for null and host-less URLs."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def induce_wrappers(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id",
                    params: WrapperParams = WrapperParams()) -> DataFrame:
    """Columns host, wrapper (JSON): one per host, from the counts over all its pages (`key` is not read).

    A task adds up the counts of its pages and hands on at most `held` at a time; sums meet per host and node or
    block, so no host's pages come together.  What too few pages have is dropped before a wrapper is made:
    a host's rows there are bounded by the nodes of 1 / rare pages."""
    rows = pages.select(host_of(col(url)).alias("host"), col(html).alias("h")).filter((F.col("host") != "") & (F.length("h") > 0))
    names = ["kind", "what", "id", "up", "label"]
    sums = ["n", "chars", "below", "place", "mains"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}

        def flush():
            columns = [*zip(*((*k, *c) for k, c in counts.items()))]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, types)], schema=types)
        for batch in batches:
            for at in pieces(batch.column(1)):
                for host, page in zip(*(batch.column(j).slice(*at).to_pylist() for j in range(2))):
                    for *what, total, digest in observe(page):
                        _add(counts, (host, *what), total, digest)
                    if len(counts) >= params.held:
                        yield flush()
        if counts:
            yield flush()
    types = pa.schema([("host", pa.string()), ("kind", pa.bool_()), ("what", pa.int32()), ("id", pa.int64()), ("up", pa.int64()),
                       ("label", pa.string()), ("n", pa.int64()), ("chars", pa.int64()), ("below", pa.int64()), ("place", pa.int64()),
                       ("mains", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
    told = rows.mapInArrow(count, "host string, kind boolean, what int, id long, up long, label string, n long, chars long, "
                                  "below long, place long, mains long, lo long, hi long")
    # a block must be on `common` of `2 * enough` pages at least, so rarer ones are not even written
    least = F.when(F.col("what") == _BLOCK_OF, params.common * 2 * params.enough).otherwise(0)
    stats = cut(told.groupBy("host", *names).agg(*[F.sum(c).alias(c) for c in sums], F.min("lo").alias("lo"), F.max("hi").alias("hi"))
                .filter(F.col("n") >= least))
    total = stats.filter(F.col("what") == _PAGE).select("host", "kind", F.col("n").alias("pages"))
    share = F.when(F.col("what").isin(_BLOCK_OF, _SAID), params.common).otherwise(params.rare)
    kept = stats.join(total, ["host", "kind"]).filter(F.col("n") >= share * F.col("pages"))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = {tuple(r[:5]): list(r[5:]) for r in pdf[[*names, *sums, "lo", "hi"]].itertuples(index=False, name=None)}
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(wrapper_of(counts, params), ensure_ascii=False)]})
    return kept.groupBy("host").applyInPandas(learn, "host string, wrapper string")


def _with_wrappers(rows: DataFrame, wrappers: DataFrame, params: WrapperParams, how: str) -> DataFrame:
    if wrappers.count() <= params.broadcast_hosts:
        return rows.join(F.broadcast(wrappers), "host", how)
    # a host with a third of the pages is dealt out over the salts
    salt = F.pmod(F.xxhash64("page"), F.lit(params.salts)).cast("int")
    spread = wrappers.withColumn("s", F.explode(F.array(*[F.lit(s) for s in range(params.salts)])))
    return rows.withColumn("s", salt).join(spread, ["host", "s"], how)


def _udf_extract(params: WrapperParams):
    @F.arrow_udf("struct<text:string,via:string>")
    def main_text(parts: Iterator[Tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: dict = {}
        for pages, wrappers in parts:
            out = []
            for page, w in (x for at in pieces(pages)
                            for x in zip(pages.slice(*at).to_pylist(), wrappers.slice(*at).to_pylist())):
                if w not in known:
                    if len(known) > 2000:
                        known.clear()
                    known[w] = (json.loads(w) if w else None, {})
                wrapper, aligned = known[w]
                out.append(extracted(page, wrapper, params, aligned))
            yield pa.StructArray.from_arrays([pa.array([t for t, _ in out], pa.string()), pa.array([v for _, v in out], pa.string())],
                                             names=["text", "via"])
    return main_text


def main_text(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id",
              params: WrapperParams = WrapperParams()) -> DataFrame:
    """Columns key, url, text, n_chars and via (see `extracted`) for every row.

    Null and empty html give an empty text, and so does a page without main
    text.  Pages without a host and pages unlike their host's template are
    extracted by a wrapper of their own.  Whole pages are read, however long;
    a page cut off inside a tag loses that tag.  Repeated rows and ids get
    equal texts.  Other columns are not read.
    """
    wrappers = cut(induce_wrappers(pages, html, url, key, params))
    rows = pages.select(col(key).alias("page"), col(url).alias("u"), col(html).alias("h"), host_of(col(url)).alias("host"))
    joined = _with_wrappers(rows, wrappers, params, "left")
    out = joined.withColumn("t", _udf_extract(params).asNondeterministic()("h", "wrapper"))
    return out.select(F.col("page").alias(key), F.col("u").alias(url), F.col("t.text").alias("text"),
                      F.length("t.text").cast("long").alias("n_chars"), F.col("t.via").alias("via"))
