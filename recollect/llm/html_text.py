"""Main text of web pages by wrapper induction.

All pages of a host are parsed whole where they are read. Their DOM trees, in which like siblings stand as one repeated node,
are aligned by simple tree matching: a greatest matching that keeps roots, order and ancestry. What the pages of a batch show is
added up by host, batch with batch. Which page stands first for a layout, and whether equal texts of two batches weigh once
or twice in its sums, depends on the batches.
Pages that match in less than half are another layout of the host. Nodes that all pages of a layout share are its template; what
varies below them are slots, and the slots decide:

* from the root down, the region is the template node that still holds most of the varying text outside links;
* below it, what holds more link text than other text, and what bears the name or role of boilerplate and holds the lesser
  part of the region's text, is left out. A name alone never removes the greater part of the varying text;
* blocks that stand, the same, in one slot of every page are template and left out too, if they make up less than a quarter
  of the region (where more is the same, the pages are copies of one article and not a frame around several). A paragraph or
  heading needs `SURE` pages that agree, as a few articles may share a sentence; loose text does not.

Each page is read against the layout that it matches best. Hosts with fewer than `least` distinct pages, and pages that match no layout of their host, have no
wrapper: there article and main elements, roles and names decide (`plain_text`).

Defined results: null or empty html gives an empty text; a null url counts as a host of its own; broken markup is read as
far as it goes, and unclosed elements end with their parent; elements may be nested to any depth; rows that repeat a page_id
are each returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, width

# Element names of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "title", "svg", "math", "xmp", "noframes"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "dd", "dt", "figcaption"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LEFT_OUT = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "label", "input", "menu", "dialog", "object", "canvas", "audio", "video", "map"} | RAW
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
# Words in class and id names of boilerplate.
NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert",
    "sidebar", "side", "aside", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "foot", "header", "masthead", "topbar", "comment", "comments", "commentlist", "disqus", "replies", "reply", "respond",
    "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login", "popup", "modal", "overlay", "widget", "widgets", "pagination", "pager", "skip", "hidden", "toolbar",
    "copyright", "disclaimer", "legal", "search",
}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Names of reader comments and adverts, which stay out however much text they hold.
STRONG = {"comment", "comments", "commentlist", "disqus", "replies", "respond", "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored"}



#: Pages that must agree before a paragraph or heading inside the region is template.
SURE = 8


class Node:
    """An element or a text; `path` stands for the labels from the root down to the element that holds it."""

    __slots__ = ("tag", "attrs", "kids", "text", "path", "parent")

    def __init__(self, tag: str, path: int, parent: int, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.path, self.parent, self.attrs, self.kids, self.text = tag, path, parent, attrs or {}, [], text


@lru_cache(4096)
def _label(tag: str, names: str, key: str) -> bytes:
    """What alignment compares: element, class and id, numbers left out."""
    return re.sub(r"\d+", "", f"{tag}|{names}|{key}").encode("utf-8", "surrogatepass")


def parse(source: str | None) -> Node:
    root = Node("#root", 0, 0)
    stack, opened = [root], Counter()
    source = source or ""
    at = 0

    def close(tags: set[str], stop: set[str]) -> None:
        """End the innermost open element of `tags`, unless one of `stop` is nearer."""
        if not any(opened[t] for t in tags):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in tags:
                cut(depth)
                return
            if stack[depth].tag in stop:
                return

    def cut(depth: int) -> None:
        opened.subtract(n.tag for n in stack[depth:])
        del stack[depth:]

    while at < len(source):
        found = TOKEN.search(source, at)
        if (start := found.start() if found else len(source)) > at:
            stack[-1].kids.append(Node("#text", stack[-1].path, stack[-1].parent, text=entities.unescape(source[at:start])))
        if not found:
            break
        at = found.end()
        if not (name := found[2]):
            continue
        tag = name.lower()
        if found[1]:
            if opened[tag] > 0:
                close({tag}, set())
            continue
        attrs = {m[1].lower(): entities.unescape(next((g for g in m.groups()[1:] if g is not None), "")) for m in ATTRIBUTE.finditer(found[3])} if found[3].strip() else {}
        if tag in ENDS_P:
            close({"p"}, {"table", "div", "section", "article", "body", "td", "li", "blockquote"})
        if tag == "li":
            close({"li"}, {"ul", "ol", "menu"})
        elif tag in ("dd", "dt"):
            close({"dd", "dt"}, {"dl"})
        elif tag in ("td", "th"):
            close({"td", "th"}, {"tr", "table"})
        elif tag == "tr":
            close({"tr"}, {"table"})
        elif tag == "option":
            close({"option"}, {"select"})
        elif tag == "body":
            close({"head"}, {"html"})
        above = stack[-1].path
        node = Node(tag, xxhash.xxh64_intdigest(_label(tag, attrs.get("class", ""), attrs.get("id", "")), above) >> 1, above, attrs)
        stack[-1].kids.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = end.end() if end else len(source)
        elif not found[3].rstrip().endswith("/") or tag in BLOCK:
            stack.append(node)
            opened[tag] += 1
    return root


def elements(root: Node) -> Iterator[Node]:
    """Elements in page order."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [k for k in reversed(node.kids) if k.tag != "#text"]


def _names(attrs: dict[str, str]) -> set[str]:
    joined = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
    return set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", joined).lower())) if joined else set()


def unseen(node: Node) -> bool:
    """Never shown or never text, by itself."""
    a = node.attrs
    return node.tag in RAW or node.tag == "head" or "hidden" in a or a.get("aria-hidden") == "true" or ("style" in a and HIDDEN.search(a["style"]) is not None)


def sign(node: Node) -> int:
    """2 for elements, roles and names that are boilerplate whatever they hold, 1 for those that mostly are, 0 for others."""
    names = _names(node.attrs)
    if node.tag in LEFT_OUT - {"header"} or node.attrs.get("role", "").lower() in ROLES or names & STRONG:
        return 2
    if node.tag == "header" or names & NAMES:
        return 0 if any(k.tag in HEADINGS for k in node.kids) else 1
    return 0


def _tidy(text: str) -> str:
    return SPACE.sub(" ", text).strip()


def blocks(root: Node, skip: Callable[[Node], bool]) -> list[tuple[int, str, int]]:
    """Blocks in page order: path of the block element, text, and how much of it is links."""
    out: list[tuple[int, str, int]] = []
    part: list[str] = []
    linked = 0

    def flush(path: int) -> None:
        nonlocal linked
        if part and (text := _tidy("".join(part))):
            out.append((path, text, min(linked, len(text))))
        part.clear()
        linked = 0

    # (node, path of the block around it, within a link); a block comes a second time when it ends
    stack: list[tuple[Node | None, int, bool]] = [(root, root.path, False)]
    while stack:
        node, path, link = stack.pop()
        if node is None:
            flush(path)
        elif node.tag == "#text":
            part.append(node.text)
            linked += len(_tidy(node.text)) if link else 0
        elif node.tag == "br":
            part.append(" ")
        elif node is root or not skip(node):
            if node.tag in BLOCK or node is root:
                flush(path)
                path = node.path
                stack.append((None, path, False))
            link = link or node.tag == "a"
            stack += [(k, path, link) for k in reversed(node.kids)]
    return out


class Page:
    """A page as its distinct paths: parents, children in order, signs, and its blocks."""

    def __init__(self, source: str | None):
        self.root = parse(source)
        self.parent: dict[int, int] = {}
        self.kids: dict[int, list[int]] = {}
        self.tag: dict[int, str] = {}
        self.sign: dict[int, int] = {}
        for node in elements(self.root):
            if node.path not in self.tag:
                self.parent[node.path], self.tag[node.path], self.sign[node.path] = node.parent, node.tag, sign(node)
                self.kids[node.path] = []
                if node.path:
                    self.kids[node.parent].append(node.path)
            else:
                self.sign[node.path] = min(self.sign[node.path], sign(node))
        self.blocks = blocks(self.root, unseen)

    def sums(self, own: Counter) -> Counter:
        """`own` by path, added up to all ancestors."""
        total = Counter(own)
        for path in reversed(self.tag):  # children come after their parents
            if path:
                total[self.parent[path]] += total[path]
        return total


def _chain(order: list[int], weight: list[int]) -> list[int]:
    """Indexes of the heaviest chain along which `order` rises."""
    best: list[tuple[int, int]] = []  # by place: weight and index, as a tree of maxima
    size = len(order)
    places = {p: i + 1 for i, p in enumerate(sorted(order))}
    best = [(0, -1)] * (size + 1)
    back = [-1] * size
    top = (0, -1)
    for i in range(size):
        at, found = places[order[i]] - 1, (0, -1)
        while at:
            found = max(found, best[at])
            at -= at & -at
        back[i] = found[1]
        mine = (found[0] + weight[i], i)
        top = max(top, mine)
        at = places[order[i]]
        while at <= size:
            best[at] = max(best[at], mine)
            at += at & -at
    out, at = [], top[1]
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def matched(a: Page | Layout, b: Page | Layout) -> set[int]:
    """Paths in a greatest matching of two trees that keeps roots, order and ancestry (simple tree matching).

    Like siblings stand as one node, so a child has one partner at most, and the matching of two lists of children is the
    heaviest chain of partners in the same order."""
    weight: dict[int, int] = {}
    chosen: dict[int, list[int]] = {}
    for path in reversed(a.tag):
        if path in b.tag:
            place = {k: i for i, k in enumerate(b.kids[path])}
            common = [k for k in a.kids[path] if k in place]
            chain = _chain([place[k] for k in common], [weight[k] for k in common])
            chosen[path] = [common[i] for i in chain]
            weight[path] = 1 + sum(weight[k] for k in chosen[path])
    out, stack = set(), [0]
    while stack:
        path = stack.pop()
        out.add(path)
        stack += chosen[path]
    return out


class Layout:
    """What pages that match each other have shown so far; two of them add up, so every page of a host is counted where it is read.

    `tag` and `kids` are the first page's; `fixed` holds the blocks of every page with the sums of their plain, linked and all
    characters; `texts` the least hashes of page texts, `SURE` at most."""

    __slots__ = ("tag", "kids", "frame", "tags", "parent", "sign", "fixed", "plain", "links", "texts")

    def __init__(self, page: Page):
        self.tag, self.kids, self.frame = page.tag, page.kids, set(page.tag)
        self.tags, self.parent, self.sign = dict(page.tag), dict(page.parent), dict(page.sign)
        self.fixed: dict[tuple[int, str], list[int]] = {}
        self.plain, self.links = Counter(), Counter()
        for path, text, linked in page.blocks:
            one = (len(text) - linked, linked, len(text))
            self.fixed[path, text] = [x + y for x, y in zip(self.fixed.get((path, text), (0, 0, 0)), one)]
            self.plain[path] += one[0]
            self.links[path] += linked
        self.texts = {xxhash.xxh64_intdigest("\n".join(b[1] for b in page.blocks).encode("utf-8", "surrogatepass"))}

    def __getstate__(self) -> tuple:
        return tuple(getattr(self, k) for k in self.__slots__)

    def __setstate__(self, found: tuple) -> None:
        for k, v in zip(self.__slots__, found):
            setattr(self, k, v)

    def add(self, other: Layout, both: set[int]) -> None:
        self.frame &= other.frame & both
        self.tags.update(other.tags)
        self.parent.update(other.parent)
        for path, found in other.sign.items():
            self.sign[path] = min(found, self.sign.get(path, 2))
        self.fixed = {pair: [x + y for x, y in zip(sums, other.fixed[pair])] for pair, sums in self.fixed.items() if pair in other.fixed}
        self.plain.update(other.plain)
        self.links.update(other.links)
        self.texts = set(sorted(self.texts | other.texts)[:SURE])


def gathered(parts: Iterator[Layout], alike: float = 0.5) -> list[Layout]:
    """Those that match each other added up."""
    out: list[Layout] = []
    for part in parts:
        for own in out:
            need = alike * (len(own.tag) + len(part.tag))
            if own.kids == part.kids:
                own.add(part, set(own.tag))
                break
            if 2 * len(own.tag.keys() & part.tag.keys()) >= need and 2 * len(both := matched(own, part)) >= need:
                own.add(part, both)
                break
        else:
            out.append(part)
    return out


def read_layouts(sources: list[str]) -> list[Layout]:
    """Layouts of some pages. Pages of equal text count once."""
    pages = {tuple(b[1] for b in p.blocks): p for p in map(Page, sources)}
    return gathered(map(Layout, pages.values()))


def induce(sources: list[str], least: int = 3) -> list[dict]:
    """The layouts of a host with `least` pages (`SURE` at most) or more: frame (paths), region (path), out (paths), known (paths), texts ([path, text])."""
    return fitted(read_layouts([s for s in sources if s]), least)


def fitted(found: list[Layout], least: int) -> list[dict]:
    return [_layout(own) for own in found if len(own.texts) >= least]


def _layout(own: Layout) -> dict:
    frame, tag, signs, parent = own.frame, own.tags, own.sign, own.parent
    constant = {pair: sums for pair, sums in own.fixed.items() if pair[0] in frame}
    plain, links, fixed = Counter(own.plain), Counter(own.links), Counter()
    for (path, _), (a, b, c) in constant.items():
        plain[path] -= a
        links[path] -= b
        fixed[path] += c
    kids: dict[int, list[int]] = {}
    for path in tag:
        if path:
            kids.setdefault(parent[path], []).append(path)
    order = [0]
    for path in order:
        order += kids.get(path, ())
    for path in reversed(order):
        if path:
            for total in (plain, links, fixed):
                total[parent[path]] += total[path]
    region = 0
    while True:
        inner = [k for k in own.kids[region] if k in frame]
        able = [k for k in inner if tag[k] not in PROSE and tag[k] not in LEFT_OUT]
        best = max(able, key=lambda k: plain[k], default=None)
        # a heading beside the text belongs to it
        if best is None or 2 * plain[best] <= plain[region] or any(tag[k] in HEADINGS for k in inner):
            break
        region = best
    below = {region}
    for path in order:
        if path and parent[path] in below:
            below.add(path)
    out = set()
    for path in below - {region}:
        greater = 2 * plain[path] > plain[region] and plain[path]
        if signs[path] == 2 and (not greater or tag[path] in LEFT_OUT) or signs[path] == 1 and not greater:
            out.add(path)
        elif tag[path] in BLOCK and tag[path] not in PROSE and links[path] > plain[path] and not greater:
            out.add(path)
    whole = plain[region] + links[region] + fixed[region]
    texts = sorted(pair for pair in constant if pair[0] in below and (len(own.texts) >= SURE or tag[pair[0]] not in PROSE)) if 4 * fixed[region] < whole else []
    return {"frame": sorted(frame), "region": region, "out": sorted(out), "known": sorted(below), "texts": texts}


class Wrapper:
    """The layouts of a host, ready for use."""

    def __init__(self, found: list[dict]):
        self.layouts = [(frozenset(w["frame"]), w["region"], frozenset(w["out"]), frozenset(w["known"]), frozenset((p, t) for p, t in w["texts"])) for w in found]

    def text(self, source: str | None) -> str:
        root = parse(source)
        if not self.layouts:
            return plain_text(root)
        nodes = list(elements(root))
        paths = {n.path for n in nodes}
        share = lambda w: len(w[0] & paths) / max(1, len(w[0]))
        best = max(self.layouts, key=share)
        frame, region, out, known, texts = best
        if region not in paths or share(best) < 0.6:
            return plain_text(root)
        # what the reference pages did not have goes by its own sign
        skip = lambda n: unseen(n) or n.path in out or (n.path not in known and sign(n) > 0)
        return "\n".join(text for n in nodes if n.path == region and not unseen(n) for path, text, _ in blocks(n, skip) if (path, text) not in texts)


def plain_text(root: Node) -> str:
    """Without a wrapper: the outermost articles, else main elements, else the subtree with nearly all text, less what has a sign."""
    skip = lambda n: unseen(n) or (sign(n) > 0 and n.tag not in ("article", "main", "body", "html"))
    held = []
    for test in (lambda n: n.tag == "article" and sign(n) < 2, lambda n: n.tag == "main" or n.attrs.get("role") == "main"):
        stack = [root]
        while stack and not held or stack:
            node = stack.pop()
            if test(node):
                held.append(node)
            else:
                stack += [k for k in reversed(node.kids) if k.tag != "#text" and not skip(k)]
        if held:
            break
    return "\n".join(text for n in held or [_densest(root, skip)] for _, text, _ in blocks(n, skip))


def _densest(root: Node, skip: Callable[[Node], bool]) -> Node:
    """Down to the subtree that holds nearly all text, headings with it."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [k for k in node.kids if k.tag == "#text" or not skip(k)]
    size: dict[int, int] = {}
    for node in reversed(order):
        size[id(node)] = len(_tidy(node.text)) if node.tag == "#text" else sum(size.get(id(k), 0) for k in node.kids)
    node = root
    while True:
        inner = [k for k in node.kids if k.tag in BLOCK and k.tag not in PROSE and id(k) in size]
        best = max(inner, key=lambda k: size[id(k)], default=None)
        if best is None or size[id(best)] < 0.8 * size[id(node)] or any(k.tag in HEADINGS for k in node.kids):
            return node
        node = best


def host(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/?#:]*)", 1)), F.lit("\x00"))


#: Parts of a host that one task adds up.
TOGETHER = 16


def wrappers(pages: DataFrame, least: int = 3) -> DataFrame:
    """host and wrapper (JSON list of layouts) of every host with a layout, fitted on all its pages; `pages` has host and html."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_host: dict[str, list[str]] = {}
            for h, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_host.setdefault(h, []).append(html)
            for h, sources in by_host.items():
                found = read_layouts(sources)
                part = xxhash.xxh64_intdigest("\n".join(sources).encode("utf-8", "surrogatepass")) >> 1
                yield pa.RecordBatch.from_arrays([pa.array([h]), pa.array([part], pa.int64()), pa.array([pickle.dumps(found)], pa.binary())], ["host", "part", "found"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        held = (x for _, found in sorted(zip(rows["part"].to_pylist(), rows["found"].to_pylist())) for x in pickle.loads(found))
        return pa.table({"host": [key[0].as_py()], "part": pa.array([key[1].as_py()], pa.int64()), "found": pa.array([pickle.dumps(gathered(held))], pa.binary())})

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(h, json.dumps(w)) for h, found in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()) if (w := fitted(pickle.loads(found), least))]
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], pa.string()) for k in (0, 1)], ["host", "wrapper"])

    schema = "host string, part bigint, found binary"
    parts = checkpointed(pages.where("html != ''").select("host", "html").mapInArrow(read, schema))
    most = parts.groupBy("host").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    # some TOGETHER parts of a host meet in a task, then the sums of these, until one is left
    groups = 1
    while groups * TOGETHER < most:
        groups *= TOGETHER
    while True:
        parts = parts.withColumn("part", F.pmod("part", F.lit(groups))).groupBy("host", "part").applyInArrow(add, schema)
        if groups == 1:
            return parts.mapInArrow(fit, "host string, wrapper string")
        groups //= TOGETHER


#: Wrappers of up to so many characters in all are broadcast; beyond, pages meet theirs by host.
BROADCAST_CHARS = 8 << 20
OUT = "page_id bigint, url string, text string"


def _reader(wrapper: Callable[[str | None, str | None], Wrapper]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [wrapper(h, w).text(page) for page, h, w in zip(*(part.column(k).to_pylist() for k in (2, 3, 4)))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 3, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """One row per row of `pages`: page_id, url, text."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(url_col).alias("host"))
    found = checkpointed(wrappers(rows, least))
    if (found.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0) <= broadcast_chars:
        shared = spark.sparkContext.broadcast({r["host"]: r["wrapper"] for r in found.collect()})  # checked just above
        read = _reader(_cached(lambda h, _: shared.value.get(h)))
        return rows.select("page_id", "url", "html", "host", F.lit(None).cast("string").alias("wrapper")).mapInArrow(read, OUT)
    # a host with more than its part of a task is dealt over as many chunks as it asks for
    part = max(1, rows.count() // (4 * width(spark)))
    hot = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part).select("host", F.ceil(F.col("n") / part).cast("int").alias("chunks"))
    dealt = rows.join(F.broadcast(hot), "host", "left").withColumn("chunk", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("chunks", F.lit(1))).cast("int"))
    spread = found.join(F.broadcast(hot), "host", "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
    joined = dealt.drop("chunks").join(spread.drop("chunks"), ["host", "chunk"], "left")
    return joined.select("page_id", "url", "html", "host", "wrapper").mapInArrow(_reader(_cached(lambda _, w: w)), OUT)


def _cached(find: Callable[[str | None, str | None], str | None]) -> Callable[[str | None, str | None], Wrapper]:
    """Wrappers of the hosts met last, at most 256 in a task."""
    made: dict[str | None, Wrapper] = {}

    def wrapper(h: str | None, w: str | None) -> Wrapper:
        if h not in made:
            if len(made) >= 256:
                made.clear()
            made[h] = Wrapper(json.loads(find(h, w) or "[]"))
        return made[h]

    return wrapper


def pages_text(pages: DataFrame) -> DataFrame:
    return extract_pages(pages).select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
