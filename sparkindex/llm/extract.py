"""HTML main text by wrapper induction.

Pages of one host are made by one template. Each page becomes a tree of its block
elements; a host's wrapper is a tree too, and pages are aligned to it one after another
by simple tree matching: equal labels match, equal texts better, and the children of
matched nodes by the order-preserving pairing of greatest weight; long lists of siblings
are first cut at texts that both have once. Noise is left out, all else of a page is aligned,
and a large wrapper loses nodes that less than a tenth of its articles have. Every wrapper
node counts how often it was seen, how many characters it held, and by how many votes its
commonest text leads. A node that most pages of the host have, with nearly always the same
text, is template, if enough articles say so for its length; nodes whose text varies are
slots, and slots are content. Partial wrappers of partitions are merged by the same
alignment, in two steps, so a host with most of the pages is spread over all partitions.

Counts are over articles, not pages: copies and near copies of a page say nothing about
the template. A page has two marks, each the block that is least by a hash weighted with
the square of its length (two pages share a mark as likely as they share text, long
blocks above all), and of pages of a host that share the first mark, and then of those
left that share the second, one is learnt from.

The main text is then read from the page. The container is found in the wrapper: from the
root down, the node under which nearly all varying characters of the host's articles lie,
but no further than a node with a heading of its own. It is the node of the page that is
aligned with it; inside it, an article or main element that holds most of the text is
preferred. Only where a host has a single article, or no slot, is the container found by
the page alone, in the same way. Left out are navigation, page headers (those in no article,
main or section element) and footers, sidebars, notices, adverts, forms, scripts, styles
and comments, by element and by class or id, and template nodes, unless everything in the
container is constant (a host whose pages are copies of one text has no slot to tell).

Character references are decoded, white space inside a block becomes one space, blocks
are trimmed and joined by a blank line. Null and empty html and pages without text give an
empty text. Markup that is cut off or wrongly nested is read as far as it goes. Rows
keep their own row whatever repeats; a null url belongs to the host "".
"""

from __future__ import annotations

import html as entities
import math
import pickle
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkindex.llm.common import map_batches, materialize

#: Share of a host's articles that must have a node, and by what share of those the
#: commonest text must lead to be template (nine in ten agree: a lead of eight).
SEEN, LEAD = 0.5, 0.8
#: Articles that must agree on a template text: two, and one more for each so many characters of it.
WITNESS = 60
#: Share of the varying characters that a node must hold for the container to be in it.
HOLDS = 0.7
#: Nodes from which a wrapper loses those that are too rare to become template, and their share.
MANY_NODES, RARE = 400, 0.1
#: Pairs of siblings that are weighed one by one; longer lists are aligned by texts and labels.
MOST_CELLS = 16 * 16
HOSTS_AT_ONCE = 2000
#: Bytes of all wrappers up to which each executor gets them at once; beyond, pages are joined
#: with theirs.
SHARED_BYTES = 16 << 20
#: Blocks nested deeper than this are read as following one another.
MOST_DEEP = 120

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_BROKEN = re.compile(r"<[/a-zA-Z!?][^<>]*\Z")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
_VOID = frozenset("area base br col embed img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript iframe template textarea title svg math object noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 hr header hgroup html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody"), "tfoot": ("tbody",)}
_KEEPS = frozenset("ul ol dl table tr div article section body html".split())
_DROP = frozenset("nav aside form footer button select dialog menu head fieldset option".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr "
    "notice notices notification notifications alert popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer "
    "masthead topbar comment comments commentlist disqus respond replies related recommended recommendations share sharing social newsletter subscribe subscription "
    "signup login search pagination pager widget widgets toolbar skip copyright".split()
)
_HEADINGS = frozenset("h1 h2 h3".split())
_SECTIONS = frozenset("article main section".split())
_SPLIT = re.compile(r"[^a-z]+")


class Node:
    """A block element: label, texts and blocks inside in page order, whether it is noise."""

    __slots__ = ("children", "label", "noise", "parts", "tag")

    def __init__(self, tag: str, label: str, noise: bool):
        self.tag, self.label, self.noise = tag, label, noise
        self.parts: list[str | Node] = []
        self.children: list[Node] = []

    def own(self) -> str:
        """Its own text, without that of blocks inside."""
        return " ".join("".join(x for x in self.parts if isinstance(x, str)).split())


def _describe(tag: str, attributes: str) -> tuple[str, bool]:
    if not attributes or attributes.isspace():
        return tag, tag in _DROP
    noise, names = tag in _DROP, []
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).strip().lower()
        if name in ("class", "id"):
            names.append(value.split(" ", 1)[0])
            noise = noise or (tag not in ("html", "body", "article", "main") and not _NOISE.isdisjoint(_SPLIT.split(value)))
        elif name == "role":
            noise = noise or value in _ROLES
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            noise = True
        elif name == "style" and "display:none" in value.replace(" ", ""):
            noise = True
    return ".".join([tag, *names]), noise


def parse(source: str) -> Node:
    """The tree of block elements; inline elements give only their text."""
    root = Node("html", "html", False)
    stack: list[Node] = [root]
    inline_noise: list[str] = []  # open inline elements whose text does not count
    at, size = 0, len(source)
    lower = None

    def add(text: str) -> None:
        if text and not inline_noise:
            stack[-1].parts.append(entities.unescape(text))

    while at < size:
        m = _TAG.search(source, at)
        if m is None:
            rest = source[at:]
            broken = _BROKEN.search(rest)
            add(rest[: broken.start()] if broken else rest)
            break
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in _RAW:
            if not m[1] and not m[3].endswith("/"):
                lower = source.lower() if lower is None else lower
                if len(lower) != size:  # a character grew when lower-cased
                    lower = "".join(c.lower() if c < "\x80" else c for c in source)
                end = lower.find("</" + tag, at)
                at = size if end < 0 else (source.find(">", end) + 1 or size)
        elif tag == "br":
            add(" ")
        elif tag in _VOID:
            continue
        elif tag == "head":
            if not m[1]:
                lower = source.lower() if lower is None else lower
                node = Node("head", "head", True)
                stack[-1].parts.append(node)
                stack[-1].children.append(node)
                stack.append(node)
            elif stack[-1].tag == "head":
                stack.pop()
        elif tag in _BLOCK:
            if tag == "body" and not m[1]:
                while len(stack) > 1:
                    stack.pop()
            if tag == "html":
                continue
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
                inline_noise.clear()
                continue
            if stack[-1].tag == "p":  # a paragraph holds no blocks
                stack.pop()
                inline_noise.clear()
            closes = _CLOSES.get(tag)
            if closes:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in closes:
                        del stack[k:]
                        if tag != "tr" or stack[-1].tag != "tr":
                            break
                    elif stack[k].tag in _KEEPS and not (tag == "tr" and stack[k].tag == "tr"):
                        break
            label, noise = _describe(tag, m[3])
            if tag == "header" and not any(x.tag in _SECTIONS for x in stack):
                noise = True
            node = Node(tag, label, noise)
            stack[-1].parts.append(node)
            stack[-1].children.append(node)
            if tag != "hr" and len(stack) < MOST_DEEP:
                stack.append(node)
        elif m[1]:
            if inline_noise and inline_noise[-1] == tag:
                inline_noise.pop()
        elif (inline_noise and inline_noise[-1] == tag) or (m[3] and not m[3].isspace() and _describe(tag, m[3])[1]):
            inline_noise.append(tag)
    return root


class Slot:
    """A wrapper node: its commonest text, how often it was seen, by how many votes the text
    leads, and the characters of all its texts."""

    __slots__ = ("chars", "children", "label", "lead", "node", "seen", "text")

    def __init__(self, label: str, text: int, seen: int, lead: int, chars: int, children: list[Slot], node: Node | None = None):
        self.label, self.text, self.seen, self.lead, self.chars, self.children, self.node = label, text, seen, lead, chars, children, node

    def count(self) -> int:
        return 1 + sum(c.count() for c in self.children)

    def varies(self, articles: int) -> bool:
        return not (self.seen >= SEEN * articles and self.lead >= LEAD * self.seen and self.lead >= 2 + self.chars // (self.seen * WITNESS))

    def __reduce__(self):
        return Slot, (self.label, self.text, self.seen, self.lead, self.chars, self.children)


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) if text else 0


def as_slots(node: Node) -> Slot:
    """A page's tree without noise, as a wrapper of one page."""
    text = node.own()
    return Slot(node.label, _hash(text), 1, 1, len(text), [as_slots(child) for child in node.children if not child.noise], node)


def marks(page: Node) -> tuple[int, int]:
    """Two blocks of the page's text, by which copies and near copies of it are known."""
    import xxhash

    blocks: dict[int, int] = {}

    def visit(node: Node) -> None:
        text = node.own()
        if text:
            blocks[_hash(text)] = len(text)
        for child in node.children:
            if not child.noise:
                visit(child)

    visit(page)
    found = []
    for seed in (1, 2):
        scores = ((-math.log((xxhash.xxh64_intdigest(h.to_bytes(8, "big"), seed) + 1) / 2**64) / n**2, h) for h, n in blocks.items())
        found.append(min(scores, default=(0, 0))[1] >> 1)
    return found[0], found[1]


def _alike(x: Slot, y: Slot) -> bool:
    return x.text == y.text != 0 and x.label == y.label


def pairing(a: list[Slot], b: list[Slot]) -> tuple[int, list[tuple[int, int]]]:
    """Tree matching of two lists of siblings: the weight and the matched pairs."""
    m, n = len(a), len(b)
    if not m or not n:
        return 0, []
    if m * n > MOST_CELLS:
        pairs = _long_pairing(a, b)
        return sum(1 + _alike(a[i], b[j]) for i, j in pairs), pairs
    weights = [[(1 + _alike(x, y) + (pairing(x.children, y.children)[0] if x.children and y.children else 0)) if x.label == y.label else 0 for y in b] for x in a]
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m):
        row, above, weight = best[i + 1], best[i], weights[i]
        left = 0
        for j in range(n):
            value = above[j] + weight[j] if weight[j] else 0
            if above[j + 1] > value:
                value = above[j + 1]
            if left > value:
                value = left
            row[j + 1] = left = value
    pairs, i, j = [], m, n
    while i and j:
        weight = weights[i - 1][j - 1]
        if weight and best[i][j] == best[i - 1][j - 1] + weight:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[m][n], pairs[::-1]


def _long_pairing(a: list[Slot], b: list[Slot]) -> list[tuple[int, int]]:
    """The pairs of the longest run of texts that both lists have once, and between those
    the pairing of what is left."""
    found: dict[tuple[str, int], list[list[int]]] = {}
    for side, slots in enumerate((a, b)):
        for k, slot in enumerate(slots):
            if slot.text:
                found.setdefault((slot.label, slot.text), [[], []])[side].append(k)
    once = sorted((x[0], y[0]) for x, y in found.values() if len(x) == len(y) == 1)
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(once)
    for k, (_, j) in enumerate(once):
        at = bisect_left(tails, j)
        before[k] = ends[at - 1] if at else -1
        tails[at : at + 1], ends[at : at + 1] = [j], [k]
    fixed, k = [], ends[-1] if ends else -1
    while k >= 0:
        fixed.append(once[k])
        k = before[k]
    pairs, i, j = [], 0, 0
    for x, y in [*fixed[::-1], (len(a), len(b))]:
        cells = (x - i) * (y - j)
        inner = _by_label(a[i:x], b[j:y]) if cells > MOST_CELLS else pairing(a[i:x], b[j:y])[1]
        pairs += [(i + p, j + q) for p, q in inner]
        if x < len(a) and y < len(b):
            pairs.append((x, y))
        i, j = x + 1, y + 1
    return pairs


def _by_label(a: list[Slot], b: list[Slot]) -> list[tuple[int, int]]:
    """A longest common subsequence of the labels, a row of bits at a time."""
    masks: dict[str, int] = {}
    for j, slot in enumerate(b):
        masks[slot.label] = masks.get(slot.label, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows = [full]
    for slot in a:
        row = rows[-1]
        hit = row & masks.get(slot.label, 0)
        rows.append(((row + hit) | (row - hit)) & full)
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if rows[i] >> (j - 1) & 1:
                j -= 1
                pairs.append((i, j))
    return pairs[::-1]


def merge(into: Slot, other: Slot) -> None:
    """Align other with a wrapper and add its counts; what is new is inserted in order."""
    into.seen += other.seen
    into.chars += other.chars
    if other.text == into.text:
        into.lead += other.lead
    elif other.lead > into.lead:
        into.text, into.lead = other.text, other.lead - into.lead
    else:
        into.lead -= other.lead
    _, pairs = pairing(into.children, other.children)
    for i, j in pairs:
        merge(into.children[i], other.children[j])
    matched = {j: i for i, j in pairs}
    if len(matched) < len(other.children):
        merged, at = [], 0
        for j, child in enumerate(other.children):
            if j in matched:
                merged += into.children[at : matched[j] + 1]
                at = matched[j] + 1
            else:
                merged.append(child)
        into.children = merged + into.children[at:]


def thin(wrapper: Slot, least: float) -> None:
    wrapper.children = [c for c in wrapper.children if c.seen >= least]
    for child in wrapper.children:
        thin(child, least)


def learn(wrapper: Slot | None, page: Slot) -> Slot:
    if wrapper is None:
        return page
    merge(wrapper, page)
    if wrapper.seen >= 2 / RARE and (page.seen > 1 or wrapper.seen % 16 == 0) and wrapper.count() > MANY_NODES:
        thin(wrapper, RARE * wrapper.seen)
    return wrapper


def inner(node, weight):
    """From node down to where less than HOLDS of its weight lies in one child, or a heading
    or a block of text is reached."""
    while total := weight(node):
        child = max(node.children, key=weight, default=None)
        if child is None or weight(child) < HOLDS * total or _tag(child) in _TEXT or any(_tag(c) in _HEADINGS and weight(c) for c in node.children):
            break
        node = child
    return node


_TEXT = frozenset("p ul ol dl table pre blockquote figure h1 h2 h3 h4 h5 h6".split())


def _tag(node) -> str:
    return node.label.split(".", 1)[0]


class Wrapper:
    """A learnt tree, with what is a slot in it and where its container is."""

    def __init__(self, top: Slot):
        self.top = top
        self.slots: set[int] = set()
        self.weights: dict[int, int] = {}
        self._weigh(top)
        self.container = inner(top, lambda slot: self.weights[id(slot)])

    def _weigh(self, slot: Slot) -> int:
        total = sum(self._weigh(c) for c in slot.children)
        if slot.varies(self.top.seen):
            self.slots.add(id(slot))
            total += slot.chars
        self.weights[id(slot)] = total
        return total


class Reading:
    """A page read by its host's wrapper: nodes that are template, whether any fills a slot,
    and the container."""

    def __init__(self, page: Node, wrapper: Wrapper | None):
        self.fixed: set[int] = set()
        self.slots = False
        self.weights: dict[int, int] = {}
        top = None
        if wrapper is not None and wrapper.top.seen > 1:
            top = self._align(as_slots(page), wrapper.top, wrapper)
        self.top = self._preferred(top or inner(page, self.weight))

    def _align(self, one: Slot, slot: Slot, wrapper: Wrapper) -> Node | None:
        """Marks what is template; the node of the page that is aligned with the container."""
        if one.text:
            if id(slot) in wrapper.slots:
                self.slots = True
            elif one.text == slot.text:
                self.fixed.add(id(one.node))
        found = one.node if slot is wrapper.container else None
        for i, j in pairing(one.children, slot.children)[1]:
            found = self._align(one.children[i], slot.children[j], wrapper) or found
        return found

    def weight(self, node: Node) -> int:
        """Code points of text in and below a node that is neither noise nor template."""
        if node.noise:
            return 0
        if id(node) not in self.weights:
            own = 0 if id(node) in self.fixed else sum(len(x) for x in node.parts if isinstance(x, str) and not x.isspace())
            self.weights[id(node)] = own + sum(self.weight(c) for c in node.children)
        return self.weights[id(node)]

    def _preferred(self, top: Node) -> Node:
        """The largest article in top, or else main element, if it has most of top's text."""
        for tag in ("article", "main"):
            found = max(_all(top, tag), key=self.weight, default=None)
            if found is not None and 2 * self.weight(found) >= self.weight(top):
                return found
        return top


def _all(node: Node, tag: str) -> Iterator[Node]:
    for child in node.children:
        if child.noise:
            continue
        if child.tag == tag or child.label.startswith(tag + "."):
            yield child
        else:
            yield from _all(child, tag)


def main_text(source: str | None, wrapper: Wrapper | None = None) -> str:
    """The main text of one page, given its host's wrapper."""
    if not source:
        return ""
    read = Reading(parse(source), wrapper)
    blocks: list[str] = []
    template: list[int] = []

    def visit(node: Node) -> None:
        run: list[str] = []
        for part in [*node.parts, None]:
            if isinstance(part, str):
                run.append(part)
                continue
            text = " ".join("".join(run).split())
            run = []
            if text:
                if id(node) in read.fixed:
                    template.append(len(blocks))
                blocks.append(text)
            if part is not None and not part.noise:
                visit(part)

    visit(read.top)
    if read.slots and template:
        drop = set(template)
        blocks = [b for k, b in enumerate(blocks) if k not in drop]
    return "\n\n".join(blocks)


def _host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def induce(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper) for each host."""
    spark = pages.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, source in zip(*batch.columns, strict=True):
                source = source.as_py()
                if source:
                    page = parse(source)
                    rows.append((host.as_py(), *marks(page), pickle.dumps(as_slots(page))))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["host", "m1", "m2", "tree"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        wrappers: dict[str, Slot] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(wrappers), pa.string()), pa.array([part] * len(wrappers), pa.int32()), pa.array([pickle.dumps(w) for w in wrappers.values()], pa.binary())], ["host", "part", "wrapper"])

        for batch in batches:
            for host, tree in zip(*batch.columns, strict=True):
                host = host.as_py()
                wrappers[host] = learn(wrappers.get(host), pickle.loads(tree.as_py()))
                if len(wrappers) >= HOSTS_AT_ONCE:
                    yield out()
                    wrappers.clear()
        yield out()

    def together(key: tuple, table: pa.Table) -> pa.Table:
        wrapper = None
        for one in table.column("wrapper"):
            wrapper = learn(wrapper, pickle.loads(one.as_py()))
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "wrapper": pa.array([pickle.dumps(wrapper)], pa.binary())})

    rows = pages.select(_host(pages[url_col]).alias("host"), pages[html_col].alias("html"))
    trees = map_batches(rows, read, "host string, m1 long, m2 long, tree binary")
    articles = trees.groupBy("host", "m1").agg(F.min(F.struct("tree", "m2")).alias("t")).groupBy("host", "t.m2").agg(F.min("t.tree").alias("tree"))
    parts = materialize(map_batches(articles.select("host", "tree"), partial, "host string, part int, wrapper binary"), "wrappers")
    most = parts.agg(F.max("part")).first()[0] or 0
    groups = max(1, round((most + 1) ** 0.5))
    some = parts.groupBy("host", F.pmod("part", F.lit(groups)).alias("g")).applyInArrow(together, "host string, wrapper binary")
    return materialize(some.groupBy("host").applyInArrow(together, "host string, wrapper binary"), "wrapper")


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shared_bytes: int = SHARED_BYTES) -> DataFrame:
    """(id, url, text) for each row of pages. While all wrappers together are small, every
    executor gets them and no page is shuffled."""
    wrappers = induce(pages, url_col, html_col)
    kind = pages.schema[id_col].dataType
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html"), _host(pages[url_col]).alias("host"))
    small = (wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0) <= shared_bytes
    if small:
        shared = pages.sparkSession.sparkContext.broadcast({r.host: bytes(r.wrapper) for r in wrappers.collect()})
    else:
        rows = rows.join(wrappers, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper | None] = {}
        for batch in batches:
            texts = []
            packed = [None] * batch.num_rows if small else batch.column("wrapper")
            for host, source, wrapper in zip(batch.column("host"), batch.column("html"), packed, strict=True):
                host = host.as_py()
                if host not in known:
                    if len(known) >= HOSTS_AT_ONCE:
                        known.clear()
                    data = shared.value.get(host) if small else wrapper.as_py()
                    known[host] = Wrapper(pickle.loads(data)) if data is not None else None
                texts.append(main_text(source.as_py(), known[host]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])
    return map_batches(rows.select("id", "url", "html", "host", *[] if small else ["wrapper"]), run, schema)
