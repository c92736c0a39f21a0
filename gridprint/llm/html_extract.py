"""Main-text extraction by wrapper induction over the pages of a host.

Every host gets a reference tree, grown from up to SAMPLES distinct pages that are
drawn by hash: each is aligned with the tree so far, and its unmatched nodes are
inserted. Each page's DOM tree is aligned with that of its reference by simple
tree matching, in which nodes with a text that a sampled page has there count
more; it gives nodes of the page the numbers of reference nodes. Counted over all
pages of the host, a node whose text is the same on most pages belongs to the
template, and a node whose text varies is a slot of content. A block that no
reference node matches is template if its text stands under the same path of
labels on most pages. Content is what varies inside the article or main element, or
inside the body if there is none, without the parts whose tags, roles or class
names say that they are navigation, notices, adverts, forms or comments.

Defined cases: null or empty html gives an empty text; broken markup is repaired
as browsers do for paragraphs, lists and tables; a page whose url is null is of
the host ''; repeated pages and null page_id are handled row by row; hosts with
fewer than three distinct pages have no template; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridprint.llm.common import materialise, ship, with_row_id

#: Share of a host's pages that a template text stands on, and pages that it takes.
CONSTANT, MIN_PAGES = 0.6, 3
#: Pages of a host that its reference is grown from, and nodes that an equal text counts for in tree matching.
SAMPLES, SAME_TEXT = 8, 3
#: Cells of a table of tree matching that is kept whole.
SMALL = 4096
#: Bytes of references up to which they are broadcast; beyond, they are joined.
BROADCAST_BYTES = 32 << 20

#: Element names.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title noscript iframe template svg".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROP = set("head script style noscript template iframe svg nav footer aside form button select textarea title menu dialog object canvas".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
WHOLE = set("header masthead topbar top-bar side side-bar notice notices notification banner popup modal overlay toolbar widget tags meta byline-links reply replies feedback alert skip".split())
PART = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs footer cookie cookies consent gdpr newsletter subscribe signup share sharing social related recommended recommendations comment comments disqus pagination pager copyright".split())
#: Elements that an opening one closes, up to the elements that bound the search.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Node:
    __slots__ = ("attrs", "children", "label", "number", "parent", "path", "size", "tag", "texts")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children, self.number, self.size = tag, attrs, parent, [], -1, 1
        self.label, self.path, self.texts = None, 0, frozenset()


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if "=" in raw or raw.strip() else {}


def boilerplate(node: Node, in_content: bool) -> bool:
    """Whether tag, role, class or id say that a node is no content."""
    if node.tag in DROP or node.tag == "header" and not in_content:
        return True
    if not node.attrs:
        return False
    a = attributes(node.attrs)
    if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    if node.tag in ("html", "body", "article", "main") and node.tag != "article":
        return False
    for name in f"{a.get('class', '')} {a.get('id', '')}".lower().split():
        if name in PART or name in WHOLE or any(x in PART for x in re.split(r"[-_]+", name)):
            return True
    return False


def parse(html: str | None) -> Node:
    """A tree of nodes and strings."""
    html = html or ""
    root = at = Node("#root", "", None)
    pos, end = 0, len(html)
    while pos < end:
        lt = html.find("<", pos)
        m = MARK.match(html, lt) if lt >= 0 else None
        while lt >= 0 and m is None:  # a "<" that opens nothing is text
            lt = html.find("<", lt + 1)
            m = MARK.match(html, lt) if lt >= 0 else None
        if lt < 0:
            at.children.append(html[pos:])
            break
        if lt > pos:
            at.children.append(html[pos:lt])
        pos = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                at.children.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = m[2].lower()
        if m[1]:
            node = at
            while node is not root and node.tag != tag:
                if tag not in BLOCK and node.tag in BLOCK:  # an inline end tag doesn't close blocks
                    node = root
                    break
                node = node.parent
            if node is not root:
                at = node.parent
            continue
        if tag in BLOCK:
            node = at
            while node is not root and (node.tag not in BLOCK or node.tag == "p"):
                if node.tag == "p":
                    at = node.parent
                    break
                node = node.parent
        if tag in CLOSES:
            closed, bounds = CLOSES[tag]
            node = at
            while node is not root and node.tag not in bounds:
                if node.tag in closed:
                    at = node.parent
                    break
                node = node.parent
        node = Node(tag, m[3], at)
        at.children.append(node)
        if tag in RAW and not m[3].endswith("/"):
            close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(html, pos)
            node.children.append(html[pos : close.start() if close else end])
            pos = close.end() if close else end
        elif tag not in VOID and not m[3].endswith("/"):
            at = node
    return root


def elements(node: Node) -> list[Node]:
    return [c for c in node.children if c.__class__ is Node]


def number(root: Node) -> list[Node]:
    """Number nodes in page order, hash their paths of labels and count their subtrees, without recursion."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        node.number = len(order)
        node.path = zlib.crc32(f"/{label(node)}".encode("utf-8", "surrogatepass"), node.parent.path if node.parent else 0)
        order.append(node)
        todo += elements(node)[::-1]
    for node in reversed(order):
        node.size = 1 + sum(c.size for c in elements(node))
    return order


def label(node: Node) -> str:
    """Nodes match if they have the same tag and the same class names."""
    if node.label is None:
        node.label = node.tag if "class" not in node.attrs else f"{node.tag}.{attributes(node.attrs).get('class', '')}"
    return node.label


def kin(root: Node) -> list[Node]:
    """All nodes, children before their parents."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += elements(node)
    return order[::-1]


def classes(page: Node, reference: Node) -> tuple[dict[int, int], dict[int, int]]:
    """Number of a node -> class, for both trees: subtrees of one class have the same labels and the same texts, of those that stand in both trees. Classes with such a text are odd."""
    trees = kin(page), kin(reference)
    common = set().union(*(n.texts for n in trees[0])) & set().union(*(n.texts for n in trees[1]))
    known: dict[tuple, int] = {}
    out: tuple[dict[int, int], dict[int, int]] = {}, {}
    for order, own in zip(trees, out, strict=True):
        for node in order:
            texts = node.texts & common if node.texts else node.texts
            below = tuple([own[c.number] for c in elements(node)]) if node.size > 1 else ()
            key = label(node), texts, below
            if (c := known.get(key)) is None:
                c = known[key] = 2 * len(known) + (1 if texts or any(c & 1 for c in below) else 0)
            own[node.number] = c
    return out


def anchored(xs: list[int], ys: list[int]) -> list[tuple[int, int]]:
    """Places of the equal classes with a text that stand once in either list, in the longest order that both have."""
    if not any(c & 1 for c in xs):
        return []
    once = [{c: i for i, c in enumerate(side) if c & 1 and n[c] == 1} for side in (xs, ys) for n in [Counter(side)]]
    pairs = [(i, once[1][c]) for c, i in once[0].items() if c in once[1]]
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before.append(ends[at - 1] if at else -1)
        tails[at:] = [j, *tails[at + 1 :]] if at < len(tails) else [j]
        ends[at:] = [k, *ends[at + 1 :]] if at < len(ends) else [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def heaviest(weights: list[list[int]], xs: list[int], ys: list[int]) -> tuple[int, list[tuple[int, int]]]:
    """The heaviest matching of two lists in order: (weight, places). weights: of distinct members, xs and ys: which one each place has.
    A row of the table at a time; of large tables, two bits of each cell are kept for the way back."""
    if len(xs) * len(ys) <= SMALL:
        return heaviest_of_few(weights, xs, ys)
    weights, ys = np.array(weights, np.int64), np.array(ys)
    above, moves = np.zeros(len(ys) + 1, np.int64), []
    for x in xs:
        own = weights[x][ys]
        both = above[:-1] + own
        row = np.concatenate([above[:1], np.maximum.accumulate(np.maximum(above[1:], both))])
        moves.append((np.packbits((own > 0) & (row[1:] == both)), np.packbits(row[1:] == above[1:])))
        above = row
    pairs, i, j = [], len(xs), len(ys)
    while i and j:
        match, up = (bits[(j - 1) >> 3] >> (7 - (j - 1 & 7)) & 1 for bits in moves[i - 1])
        if match:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif up:
            i -= 1
        else:
            j -= 1
    return int(above[-1]), pairs


def heaviest_of_few(weights: list[list[int]], xs: list[int], ys: list[int]) -> tuple[int, list[tuple[int, int]]]:
    """heaviest() with a whole table."""
    table = [[0] * (len(ys) + 1)]
    for x in xs:
        above, own, row, last = table[-1], weights[x], [0], 0
        for j, y in enumerate(ys):
            both, over = above[j] + own[y], above[j + 1]
            last = max(last, over, both)
            row.append(last)
        table.append(row)
    pairs, i, j = [], len(xs), len(ys)
    while i and j:
        w, here = weights[xs[i - 1]][ys[j - 1]], table[i][j]
        if w and here == table[i - 1][j - 1] + w:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif here == table[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return table[-1][-1], pairs


def align(page: Node, reference: Node) -> dict[int, int]:
    """Number of a page's node -> number of the matched reference node, by simple tree matching.

    A pair of subtree classes is matched once, however many pairs of nodes have them. Children that stand once in either
    list and are equal, texts included, are matched first, and what stands between them by the heaviest matching in order.
    """
    class_a, class_b = classes(page, reference)
    memo: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    todo = [(page, reference)]
    while todo:
        a, b = todo[-1]
        key = class_a[a.number], class_b[b.number]
        if key in memo:
            todo.pop()
            continue
        xs, ys = elements(a), elements(b)
        if not xs or not ys:
            memo[key] = 1, []
            continue
        cx, cy = [class_a[x.number] for x in xs], [class_b[y.number] for y in ys]
        fixed = anchored(cx, cy)
        stops = [(-1, -1), *fixed, (len(xs), len(ys))]
        gaps = [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(stops, stops[1:], strict=False) if k > i + 1 and m > j + 1]
        sides = [(dict(zip(cx[i:k], xs[i:k], strict=True)), dict(zip(cy[j:m], ys[j:m], strict=True))) for i, k, j, m in gaps]
        missing = [(xs[i], ys[j]) for i, j in fixed if xs[i].size > 1 and (cx[i], cy[j]) not in memo]
        for xs_, ys_ in sides:
            for c, x in xs_.items():
                if x.size > 1:
                    missing += [(x, y) for e, y in ys_.items() if y.size > 1 and (c, e) not in memo and label(x) == label(y)]
        if missing:
            todo += missing
            continue
        todo.pop()

        def weight(c: int, x: Node, e: int, y: Node) -> int:
            if label(x) != label(y):
                return 0
            same = SAME_TEXT if x.texts and y.texts and not x.texts.isdisjoint(y.texts) else 0
            return same + (memo[c, e][0] if x.size > 1 and y.size > 1 else 1)

        total, pairs = sum(weight(cx[i], xs[i], cy[j], ys[j]) for i, j in fixed), fixed
        for (i, k, j, m), (xs_, ys_) in zip(gaps, sides, strict=True):
            place_x, place_y = ({c: n for n, c in enumerate(side)} for side in (xs_, ys_))
            more, found = heaviest([[weight(c, x, e, y) for e, y in ys_.items()] for c, x in xs_.items()], [place_x[c] for c in cx[i:k]], [place_y[c] for c in cy[j:m]])
            total += more
            pairs = pairs + [(i + p, j + q) for p, q in found]
        memo[key] = 1 + total, pairs
    out, walk = {}, [(page, reference)]
    while walk:
        a, b = walk.pop()
        out[a.number] = b.number
        if pairs := memo.get((class_a[a.number], class_b[b.number]), (0, []))[1]:
            xs, ys = elements(a), elements(b)
            walk += [(xs[i], ys[j]) for i, j in pairs]
    return out


def grow(reference: Node, page: Node) -> None:
    """Add a page's texts to the nodes that it matches, and the nodes that match nothing to the tree."""
    matched = align(page, reference)
    at = {n.number: n for n in number(reference)}
    todo = [(page, reference)]
    while todo:
        a, b = todo.pop()
        b.texts = b.texts | a.texts
        after = 0  # children keep their order
        for child in elements(a):
            if child.number in matched:
                twin = at[matched[child.number]]
                after = b.children.index(twin) + 1
                todo.append((child, twin))
            else:
                b.children.insert(after, child)
                child.parent = b
                after += 1
    number(reference)


def dumped(root: Node) -> str:
    """Labels, parents and hashes of texts of a numbered tree."""
    order = number(root)
    return json.dumps([[label(n) for n in order], [n.parent.number if n.parent else -1 for n in order], [sorted(n.texts) for n in order]], separators=(",", ":"))


def loaded(reference: str | None) -> Node:
    root = Node("#root", "", None)
    if reference:
        labels, parents, texts = json.loads(reference)
        order = [root]
        for name, parent in zip(labels[1:], parents[1:], strict=True):
            node = Node(name.split(".", 1)[0], "", order[parent])
            node.label = name
            order[parent].children.append(node)
            order.append(node)
        for node, own in zip(order, texts, strict=True):
            node.texts = frozenset(own)
    number(root)
    return root


SPACE = re.compile(r"\s+")


def blocks(root: Node) -> list[tuple[int, bool, bool, int, str]]:
    """(number of the block's element, is it boilerplate, is it in an article or main element, characters in links, text) of every text block in page order."""
    out: list[tuple[int, bool, bool, int, str]] = []
    held: list[str] = []
    linked = 0
    owner: tuple[Node, bool, bool] = (root, False, False)

    def flush() -> None:
        nonlocal held, linked
        text = SPACE.sub(" ", unescape("".join(held))).strip()
        if text:
            out.append((owner[0].number, owner[1], owner[2], linked, text))
        held, linked = [], 0

    todo: list = [(root, False, False, False, owner, False)]
    while todo:
        item, drop, content, link, own, leaving = todo.pop()
        if leaving:
            flush()
            owner = own
            continue
        if isinstance(item, str):
            held.append(item)
            linked += len(item.strip()) if link else 0
            continue
        if item.tag in ("br", "img", "wbr"):
            held.append(" " if item.tag == "br" else "")
            continue
        inside = content or item.tag in ("article", "main")
        bad = drop or boilerplate(item, content)
        own_link = link or item.tag == "a"
        if item.tag in BLOCK or item.tag in DROP or bad and not drop:
            flush()
            before, owner = owner, (item, bad, inside)
            todo.append((None, drop, content, link, before, True))
        todo += [(c, bad, inside, own_link, None, False) for c in reversed(item.children)]
    flush()
    return out


def host(url: str = "url") -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _signature(node: int, text: str) -> int:
    data = text.encode("utf-8", "surrogatepass")
    return (zlib.crc32(data) << 31 ^ zlib.adler32(data) ^ node * 0x9E3779B1) & 0x7FFFFFFFFFFFFFFF


BLOCKS = "array<struct<node: long, sign: long, path: long, keep: boolean, main: boolean, text: string>>"


def read(html: str | None) -> tuple[Node, list[Node], list[tuple[int, bool, bool, int, str]]]:
    """A page's numbered tree with the hashes of its texts, its nodes and its blocks."""
    tree = parse(html)
    order, found = number(tree), blocks(tree)
    own: dict[int, set[int]] = {}
    for node, _, _, _, text in found:
        own.setdefault(node, set()).add(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    for node, hashes in own.items():
        order[node].texts = frozenset(hashes)
    return tree, order, found


def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, samples) -> (host, reference)."""
    for batch in batches:
        out = []
        for samples in batch.column(1):
            tree = loaded(None)
            for html in samples.as_py():
                grow(tree, read(html)[0])
            out.append(dumped(tree))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["host", "reference"])


def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, page_id, url, host, html, reference) -> (rid, page_id, url, host, blocks)."""
    trees: dict[str, Node] = {}
    kind = pa.list_(pa.struct([("node", pa.int64()), ("sign", pa.int64()), ("path", pa.int64()), ("keep", pa.bool_()), ("main", pa.bool_()), ("text", pa.string())]))
    for batch in batches:
        out = []
        html, reference = batch.column(4), batch.column(5)
        for i in range(batch.num_rows):
            model = reference[i].as_py() or ""
            if model not in trees:
                if len(trees) > 200:
                    trees.clear()
                trees[model] = loaded(model)
            tree, order, found = read(html[i].as_py())
            matched = align(tree, trees[model])
            rows = []
            for node, bad, inside, linked, text in found:
                to, path = matched.get(node, -1), _signature(~order[node].path, text)  # numbers of nodes aren't negative
                rows.append({"node": to, "sign": path if to < 0 else _signature(to, text), "path": path, "keep": not bad and (inside or 2 * linked <= len(text)), "main": inside, "text": text})
            out.append(rows)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(out, kind)], ["rid", "page_id", "url", "host", "blocks"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks per page."""
    ship(pages.sparkSession)
    ids = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", "html").withColumn("host", host())
    # one page of each part of a host's distinct pages that have something
    sampled = rows.where("trim(html) <> ''").groupBy("host", F.pmod(F.xxhash64("html"), F.lit(SAMPLES)).alias("part")).agg(F.min(F.struct(F.xxhash64("html", F.lit(1)).alias("h"), "html")).alias("r"))
    samples = sampled.groupBy("host").agg(F.sort_array(F.collect_list("r")).alias("rs")).select("host", F.col("rs.html").alias("samples"))
    references = materialise(samples.mapInArrow(grown, "host string, reference string"), "references")
    small = (references.agg(F.sum(F.octet_length("reference"))).first()[0] or 0) <= BROADCAST_BYTES
    paired = with_row_id(rows).join(F.broadcast(references) if small else references, "host", "left").select("rid", "page_id", "url", "host", "html", "reference")
    trees = materialise(paired.mapInArrow(aligned, f"rid long, page_id {ids}, url string, host string, blocks {BLOCKS}"), "blocks")
    # a page's body counts once, however many copies of it a host has, whatever navigation stands around them
    bodies = trees.groupBy("host", F.xxhash64(F.transform(F.filter("blocks", lambda b: b["keep"]), lambda b: b["path"])).alias("body")).agg(F.min("rid").alias("rid"))
    kept = F.filter("blocks", lambda b: b["keep"])
    unique = trees.select("rid", F.array_union(F.transform(kept, lambda b: b["sign"]), F.transform(kept, lambda b: b["path"])).alias("signs")).join(bodies.select("rid", "host"), "rid")
    pages_of = bodies.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    common = unique.select("host", F.explode("signs").alias("sign")).groupBy("host", "sign").agg(F.count(F.lit(1)).alias("n"))
    constant = common.join(pages_of, "host").where((F.col("n_pages") >= MIN_PAGES) & (F.col("n") >= CONSTANT * F.col("n_pages")))
    template = materialise(constant.groupBy("host").agg(F.collect_set("sign").alias("template")), "templates")  # at most 2 / CONSTANT times a page's blocks
    few = template.agg(F.sum(F.size("template"))).first()[0] or 0
    told = trees.join(F.broadcast(template) if 8 * few <= BROADCAST_BYTES else template, "host", "left")
    has_main = F.exists("blocks", lambda b: b["main"] & b["keep"])
    content = F.filter("blocks", lambda b: b["keep"] & (b["main"] | ~F.col("has_main")) & ~F.coalesce(F.array_contains("template", b["sign"]), F.lit(False)))
    text = F.array_join(F.transform(content, lambda b: b["text"]), "\n\n")
    return told.withColumn("has_main", has_main).select("page_id", "url", text.alias("text"), F.size(content).cast("long").alias("n_blocks")).withColumn("n_chars", F.length("text").cast("long"))
