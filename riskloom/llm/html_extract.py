"""Main text of web pages by wrapper induction.

A page is parsed into a tree of its blocks, without the zones that markup names as
no content (menus, page headers, footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments).  All pages of a host induce its wrappers: a text
block is a constant node if more than half of the other pages of its layout
have the same text at the same tag path (the second of two equal ones counts
apart).  Layouts are the whole host, pages with the same upper containers, and these
with the same class names; the last two count from three pages on, and one that
says template is enough.  Pages whose longest blocks, nine tenths of the text, are equal are
copies and count once.  A wrapper is a tree of constant nodes and the blocks around them, in a
page's order.  Each page is aligned with the trees of its layout by simple tree matching: what
meets a constant node is template, all else is in a slot.  A list of blocks that mostly differ
is one slot, and so is an article or main part that the page marks, unless all of it is template;
with such a part, only that is content.  Without one, lists and boxes that are mostly links go as well,
paragraphs and headings never do.

Names: a heading is never a zone.  Within a marked article only containers are, if every
word of a class name (for a div, an id too) says so; elsewhere the leading word does.

Counts are summed by Spark over hashes of blocks, first within a task's batches; a wrapper
holds at most twice the blocks of its pages' mean for each kind of layout.  Wrappers are
broadcast up to `MAX_BROADCAST_BYTES`; beyond it Spark joins by layout and splits
one with very many pages.  A task holds one batch of pages.

The text: character references decoded, white space inside a block one space,
blocks in page order joined by a line feed, nothing capped.  Null or empty html,
and html without content, give the empty text.  Broken markup is read as far
as possible.  Repeated rows each give a row; a null url is a host of its own.
An empty table gives an empty result.  Only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import cut

MAX_BROADCAST_BYTES = 64_000_000
SAME_PAGE = 0.9  # share of common text from which two pages are copies
LAYOUT_DEPTH = 5  # containers from the root that tell layouts

# Kinds of tags, and names in class, id and role that mark zones without content.
BLOCKS = set("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
CONTAINERS = set("article body center div html main section table tbody td tr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe svg textarea title noembed noframes xmp".split())
NO_CONTENT = set("head nav footer aside form button select menu dialog input option fieldset".split()) | RAW
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | set("p blockquote pre dd figcaption".split())  # blocks that stay however much of them is links
NAMES = set("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices
alert popup modal overlay newsletter subscribe subscription signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs header
masthead footer comment comments reply replies respond disqus share sharing social related recommended widget pagination pager toolbar
copyright search contentinfo complementary dialog alertdialog form tooltip""".split())
# Words before the one that says what a name means, owners of zones, and what such a zone can be without being content.
SCOPES = set("site page main top left right bottom global primary secondary".split())
OWNERS = set("article post entry blog story".split())
ABOUT = NAMES - set("header masthead notice notices alert form tooltip search".split())
# Within a marked article a name tells a zone only if all its words do: zones, the words before them, and what holds them.
HOLDERS = set("area bar block box buttons container content items link links list section slot widget wrap wrapper".split())
ZONES_INSIDE = CONTAINERS | set("ul ol dl".split())
PART = re.compile(r"""<(article|main|h1)\b([^>]*+)>|\brole\s*=\s*["']?main\b""", re.I)
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^"'<>]++|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>|<[!?][^>]*+>""", re.S)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


@dataclass
class Node:
    label: str
    children: list[Node] = field(default_factory=list)
    text: str = ""
    links: int = 0  # characters inside links
    main: int = 0  # number of the article or main part that holds it
    row: tuple[int, str] = (0, "")  # its block's parent and tag: blocks of one row are a list
    key: int = 0
    names: str = ""  # class names of a container that hold no digit


def _names_zone(name: str, inside_main: bool) -> bool:
    """Whether a class name or id as a whole, or its leading word, says that a zone has no content; within a main part, the whole only."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    if inside_main and not set(words) <= NAMES | SCOPES | OWNERS | HOLDERS:
        return False
    at = next((k for k, w in enumerate(words) if w not in SCOPES), len(words))
    if at + 1 < len(words) and words[at] in OWNERS:
        return words[at + 1] in ABOUT
    return at < len(words) and words[at] in NAMES and not (inside_main and words[at] in ("header", "masthead"))


def _without_content(tag: str, attributes: str, inside_main: bool) -> bool:
    if tag in NO_CONTENT or tag == "header" and not inside_main:
        return True
    if tag in ("html", "body", "main") or tag in HEADINGS or not attributes or inside_main and tag not in ZONES_INSIDE:
        return False
    named = [(name.lower(), value.strip("\"'").lower()) for name, value in NAMED.findall(attributes)]
    if tag == "article":
        return bool({w for _, value in named for w in re.split(r"[^a-z]+", value)} & {"comment", "comments", "reply", "ad", "advert", "promo", "sponsored"})
    if inside_main and tag == "section":
        named = [x for x in named if x[0] != "id"]  # the id of a section is that of its heading
    return any(_names_zone(x, inside_main) for _, value in named for x in value.split())


def _zone_end(text: str, tag: str, attributes: str, at: int, stack: list) -> int:
    """Where the zone without content ends that `tag` opens just before `at`; 0 if it opens none.

    A form, or a zone known by its name only, that holds an article or main part is none; within an article, one that holds its title.
    """
    if not _without_content(tag, attributes, stack[-1][2] > 0):
        return 0
    if tag in VOID or attributes.endswith("/"):
        return at
    end = _end_of(text, tag, at)
    if tag in NO_CONTENT and tag not in ("form", "fieldset") or tag in ("header", "article"):
        return end
    held = ("h1",) if any(t == "article" for t, _, _ in stack) else ("article", "main", "")
    for found in PART.finditer(text, at, end):
        part = (found[1] or "").lower()
        if part in held and not (part == "article" and _without_content(part, found[2], False)):
            return 0
    return end


def _class_names(attributes: str) -> str:
    words = {w for name, value in NAMED.findall(attributes) if name.lower() == "class" for w in value.strip("\"'").lower().split()}
    return "".join(f".{w}" for w in sorted(words) if not re.search(r"\d", w))


def parse(html: str | None) -> Node:
    """The tree of blocks with text; texts are leaves with label `#`. Zones without content are left out."""
    root = Node("#page")
    stack: list[tuple[str, Node, int]] = [("#page", root, 0)]  # tag, its block, number of its main part
    parts: list[str] = []
    links = in_link = 0
    text, at, end = html or "", 0, len(html or "")

    def close_block() -> None:
        nonlocal links
        if parts:
            whole = " ".join("".join(parts).split())
            if whole:
                stack[-1][1].children.append(Node("#", text=whole, links=0 if stack[-1][0] in PROSE else min(links, len(whole)), main=stack[-1][2], row=(id(stack[max(0, len(stack) - 2)][1]), stack[-1][0]), key=xxhash.xxh64_intdigest(whole.encode("utf-8", "surrogatepass"))))
            parts.clear()
        links = 0

    def add(piece: str) -> None:
        nonlocal links
        if piece:
            piece = entities.unescape(piece)
            parts.append(piece)
            if in_link:
                links += len(piece.strip())

    while at < end:
        found = TAG.search(text, at)
        if not found:
            add(text[at:])
            break
        add(text[at:found.start()])
        at = found.end()
        closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
        elif closing:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in BLOCKS:
                close_block()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
        elif zone_end := _zone_end(text, tag, attributes, at, stack):
            if not (tag in VOID or attributes.endswith("/")) and (tag in BLOCKS or tag in ("head", *RAW)):
                close_block()
            at = zone_end
        elif tag == "a":
            in_link += 1
        elif tag in BLOCKS:
            close_block()
            in_link = 0
            if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6"):
                _close_open(stack, tag)
            if tag != "hr":
                node = Node(tag, names=_class_names(attributes) if tag in CONTAINERS else "")
                stack[-1][1].children.append(node)
                marked = tag in ("article", "main") or bool(re.search(r"""role\s*=\s*["']?main""", attributes))
                stack.append((tag, node, stack[-1][2] or (at if marked else 0)))
    close_block()
    return root


def _close_open(stack: list, tag: str) -> None:
    """A new paragraph, item or cell ends an open one; an open one of an outer list or table stays."""
    outer = {"li": ("ul", "ol", "menu"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "dt": ("dl",), "dd": ("dl",)}.get(tag, ())
    ended = {"td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "li": ("li",), "tr": ("tr",)}.get(tag, ("p",))
    for k in range(len(stack) - 1, 0, -1):
        if stack[k][0] in ended:
            del stack[k:]
            return
        if stack[k][0] in outer or not outer and stack[k][0] != "p":
            return


def _end_of(text: str, tag: str, at: int) -> int:
    """The place behind the end tag that closes `tag`, opened just before `at`; the end of the text if there is none."""
    if tag in RAW or tag == "head":
        found = re.compile(rf"</{tag}\b[^>]*+>" + (r"|(?=<body\b)" if tag == "head" else ""), re.I).search(text, at)
        return found.end() if found else len(text)
    depth = 1
    for found in TAG.finditer(text, at):
        closing, name, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        name = (name or "").lower()
        if name in ("script", "style") and not closing:
            continue
        if name == tag and not attributes.endswith("/"):
            depth += -1 if closing else 1
            if not depth:
                return found.end()
        elif not closing and depth == 1 and name in ("article", "main"):
            return found.start()  # a zone that was never closed does not swallow the article
    return at if tag not in NO_CONTENT else len(text)


def leaves(node: Node) -> list[Node]:
    out, stack = [], [node]
    while stack:
        top = stack.pop()
        if top.label == "#":
            out.append(top)
        stack.extend(reversed(top.children))
    return out


def signature(root: Node) -> str:
    """The tree as JSON rows [depth, label, text hash], parents first."""
    rows, stack = [], [(0, root)]
    while stack:
        depth, node = stack.pop()
        rows.append([depth, node.label, node.key])
        stack.extend((depth + 1, c) for c in reversed(node.children))
    return json.dumps(rows, separators=(",", ":"))


def from_signature(data: str, wanted=None) -> Node:
    """The tree of a signature; with `wanted`, a test of a text leaf's number and hash, only such leaves and the blocks around them. A leaf's `main` is its number."""
    path: list[Node] = []
    held = number = 0  # so many blocks of the path are in the tree
    for depth, label, key in json.loads(data):
        del path[depth:]
        held = min(held, depth)
        node = Node(label, key=key)
        path.append(node)
        if label == "#":
            node.main, number = number, number + 1
        if depth and (wanted is None or label == "#" and wanted(node.main, key)):
            for k in range(max(held, 1), depth + 1):
                path[k - 1].children.append(path[k])
            held = depth + 1
    return path[0]


def shape(node: Node) -> int:
    """A hash of the whole subtree, also kept in `key` of inner nodes."""
    order, stack = [], [node]
    while stack:
        top = stack.pop()
        order.append(top)
        stack.extend(top.children)
    for top in reversed(order):
        if top.label != "#":
            top.key = xxhash.xxh64_intdigest(f"{top.label} {' '.join(str(c.key) for c in top.children)}".encode())
    return node.key


def constant(page: Node, reference: Node) -> set[int]:
    """ids of the page's text leaves that match a leaf of equal text; both trees have their shapes.

    Plain simple tree matching of two small trees, which tests hold against the counts of `wrappers`.
    """
    weights: dict[tuple[int, int], tuple[int, list[tuple[Node, Node]]]] = {}

    def weigh(a: Node, b: Node) -> int:
        """Size of the best matching of two subtrees that keeps order and ancestry; equal texts count double."""
        if a.label != b.label:
            return 0
        if a.label == "#":
            return 2 if a.key == b.key else 1
        known = weights.get((id(a), id(b)))
        if known:
            return known[0]
        pairs: list[tuple[Node, Node]] = []
        x, y = a.children, b.children
        grid = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            above, row = grid[i], grid[i + 1]
            for j, q in enumerate(y):
                row[j + 1] = max(above[j] + weigh(p, q), above[j + 1], row[j])
        total, i, j = 1 + grid[-1][-1], len(x), len(y)
        while i and j:
            if grid[i][j] == grid[i - 1][j]:
                i -= 1
            elif grid[i][j] == grid[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((x[i], y[j]))
        weights[id(a), id(b)] = total, pairs
        return total

    weigh(page, reference)
    out, stack = set(), [(page, reference)]
    while stack:
        a, b = stack.pop()
        if a.label == "#":
            if a.key == b.key:
                out.add(id(a))
        elif a.key == b.key:
            out.update(id(leaf) for leaf in leaves(a))
        else:
            stack.extend(weights.get((id(a), id(b)), (0, []))[1])
    return out


def _ends(x: list[Node], y: list[Node]) -> tuple[int, int]:
    """How many children are equal subtrees at the start and, of the rest, at the end; an ordered matching loses nothing by taking them."""
    least = min(len(x), len(y))
    head = next((k for k in range(least) if x[k].key != y[k].key), least)
    tail = next((k for k in range(least - head) if x[-1 - k].key != y[-1 - k].key), least - head)
    return head, tail


def align(page: Node, wrapper: Node) -> list[int]:
    """Numbers of the page's text leaves that simple tree matching pairs with a leaf of the wrapper; both trees have their shapes.

    The matching keeps order and ancestry, pairs equal tags and equal texts only, and has the most text leaves. Equal subtrees need
    no grid. Depth is bounded by the page alone; a grid takes a byte for each pair of children that no equal ends take away.
    """
    sizes: dict[int, int] = {}
    for root in (page, wrapper):
        order, stack = [], [root]
        while stack:
            order.append(stack.pop())
            stack.extend(order[-1].children)
        for top in reversed(order):
            sizes[id(top)] = 1 if top.label == "#" else sum(sizes[id(c)] for c in top.children)
    known: dict[tuple[int, int], tuple[int, list[tuple[Node, Node]]]] = {}

    def weight(p: Node, q: Node) -> int:
        return sizes[id(p)] if p.key == q.key and p.label == q.label else known.get((id(p), id(q)), (0, []))[0]

    todo = [(page, wrapper, False)]
    while todo:
        a, b, ready = todo.pop()
        if (id(a), id(b)) in known or a.label != b.label or a.label == "#" or a.key == b.key:
            continue
        head, tail = _ends(a.children, b.children)
        x, y = a.children[head:len(a.children) - tail], b.children[head:len(b.children) - tail]
        if not ready:
            todo.append((a, b, True))
            todo.extend((p, q, False) for p in x for q in y if p.label == q.label != "#" and p.key != q.key)
            continue
        pairs = [*zip(a.children[:head], b.children[:head], strict=True)]
        pairs += zip(a.children[len(a.children) - tail:], b.children[len(b.children) - tail:], strict=True)
        total, above, moves = sum(sizes[id(p)] for p, _ in pairs), [0] * (len(y) + 1), []
        for p in x:
            row, move = [0], bytearray(1)
            for j, q in enumerate(y):
                w = weight(p, q)
                best = max(above[j + 1], row[j])
                both = above[j] + w if w else 0
                row.append(max(best, both))
                move.append(2 if both > best else int(row[j] > above[j + 1]))
            above = row
            moves.append(move)
        i, j = len(x), len(y)
        while i and j:
            step = moves[i - 1][j]
            if step == 2:
                pairs.append((x[i - 1], y[j - 1]))
            i, j = i - (step != 1), j - (step != 0)
        known[id(a), id(b)] = total + above[-1], pairs
    out, stack = [], [(page, wrapper)]
    while stack:
        a, b = stack.pop()
        if a.label == b.label and a.key == b.key:
            out.extend(leaf.main for leaf in leaves(a))
        else:
            stack.extend(known.get((id(a), id(b)), (0, []))[1])
    return out


def leaf_keys(root: Node) -> tuple[list[Node], list[int]]:
    """The text leaves, and for each a hash of its tag path, its text and how many equal ones the page has before it."""
    found, keys, seen = [], [], {}
    stack = [(root, 0)]
    paths: dict[tuple[int, str], int] = {}
    while stack:
        top, path = stack.pop()
        if top.label == "#":
            at = (path, top.key)
            seen[at] = seen.get(at, 0) + 1
            found.append(top)
            keys.append(xxhash.xxh64_intdigest(b"%d %d %d" % (path, top.key, seen[at])))
            continue
        for child in reversed(top.children):
            step = (path, child.label)
            if step not in paths:
                paths[step] = xxhash.xxh64_intdigest(b"%d %s" % (path, child.label.encode()))
            stack.append((child, paths[step]))
    return found, keys


def layouts(root: Node, of_host: str) -> list[int]:
    """Hashes of the host, of the host and the page's upper containers, and of these with their class names."""
    tags, named, stack = set(), set(), [(root, (), ())]
    while stack:
        top, path, names = stack.pop()
        for child in top.children:
            if child.label in CONTAINERS:
                below, below_names = (*path, child.label), (*names, child.label + child.names)
                tags.add(below)
                named.add(below_names)
                if len(below) < LAYOUT_DEPTH:
                    stack.append((child, below, below_names))
    return [xxhash.xxh64_intdigest(json.dumps([k, of_host, *sorted(x)]).encode("utf-8", "surrogatepass")) for k, x in enumerate((set(), tags, named))]


def copy_key(found: list[Node], keys: list[int]) -> int:
    """A hash of the longest leaves, which make nine tenths of the text: pages with equal ones are copies."""
    total, held, least = sum(len(t.text) for t in found), 0, 0
    for size in sorted((len(t.text) for t in found), reverse=True):
        if held >= SAME_PAGE * total:
            break
        held, least = held + size, size
    return xxhash.xxh64_intdigest(np.sort(np.array([k for t, k in zip(found, keys, strict=True) if len(t.text) >= least], np.uint64)).tobytes())


def content(texts: list[str], links: list[int], mains: list[int], rows: list[int], constant: list[bool]) -> str:
    """The text of a page, given by its leaves and whether each is template."""
    # A list of blocks, most of which differ, is a slot as a whole, and so is a marked main part unless all of it is template.
    differing: dict[int, int] = {}
    parts: dict[int, bool] = {}
    for main, row, same in zip(mains, rows, constant, strict=True):
        differing[row] = differing.get(row, 0) + (-1 if same else 1)
        parts[main] = parts.get(main, False) or not same
    if any(mains):
        return "\n".join(t for t, main in zip(texts, mains, strict=True) if main and parts[main])
    return "\n".join(t for t, n, row, same in zip(texts, links, rows, constant, strict=True) if (not same or differing[row] > 0) and 2 * n <= len(t))


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _long(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def outlines(pages: DataFrame) -> DataFrame:
    """A row per page with text: its three layouts, its copy key, its leaves' keys and its tree."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ws: list[list[int]] = [[], [], []]
            copies, packed, trees = [], [], []
            for of_host, html in zip(batch.column(0), batch.column(1), strict=True):
                root = parse(html.as_py())
                found, keys = leaf_keys(root)
                if found:
                    for w, k in zip(ws, layouts(root, of_host.as_py()), strict=True):
                        w.append(k)
                    copies.append(copy_key(found, keys))
                    packed.append(np.array(keys, np.uint64).tobytes())
                    trees.append(signature(root))
            yield pa.RecordBatch.from_arrays([*map(_long, ws), _long(copies), pa.array(packed, pa.binary()), pa.array(trees, pa.string())], ["w0", "w1", "w2", "copy", "keys", "tree"])

    return pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(each, "w0 long, w1 long, w2 long, copy long, keys binary, tree string")


def _key_counts(firsts: DataFrame) -> DataFrame:
    """(w, key, n): on how many of the rows of layout w the leaf `key` is."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(k.as_py(), np.int64) for k in batch.column(3)]
            sizes = [len(k) for k in keys]
            for level in range(3):
                pairs = np.empty(sum(sizes), [("w", np.int64), ("key", np.int64)])
                pairs["w"], pairs["key"] = np.repeat(batch.column(level).to_numpy(), sizes), np.concatenate([np.empty(0, np.int64), *keys])
                found, n = np.unique(pairs, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found["w"].copy()), pa.array(found["key"].copy()), pa.array(n)], ["w", "key", "n"])

    return firsts.select("w0", "w1", "w2", "keys").mapInArrow(each, "w long, key long, n long").groupBy("w", "key").agg(F.sum("n").alias("n"))


def _join_small(rows: DataFrame, small: DataFrame, size: Column, how: str) -> DataFrame:
    """Rows with what `small` has for their w2, broadcast up to MAX_BROADCAST_BYTES of it."""
    fits = (small.agg(F.sum(size)).first()[0] or 0) <= MAX_BROADCAST_BYTES
    return rows.join(F.broadcast(small) if fits else small, "w2", how)


def _bare_trees(outlined: DataFrame) -> DataFrame:
    """(w2, tree, keys): the trees of pages cut down to their constant leaves, and the keys of these; equal ones of a batch once."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, str], list[int]] = {}
            for w2, tree, packed, template in zip(*batch.columns, strict=True):
                keys = np.frombuffer(packed.as_py(), np.int64)
                same = np.isin(keys, template.values.to_numpy())
                if same.any():
                    bare = signature(from_signature(tree.as_py(), lambda number, _, same=same: same[number]))
                    found[w2.as_py(), bare] = keys[same].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.int64()), pa.array([t for _, t in found], pa.string()), pa.array(list(found.values()), pa.list_(pa.int64()))], ["w2", "tree", "keys"])

    return outlined.select("w2", "tree", "keys", "template").mapInArrow(each, "w2 long, tree string, keys array<bigint>")


def wrappers(pages: DataFrame) -> DataFrame:
    """(w2, trees): for each layout the trees of its constant nodes, which are counted over all pages.

    The nodes come with the tree of the page that has most of them; a node that this page lacks, with that of the page
    that has most of those which have it. So every constant node of the layout is in a tree, and most layouts have one.
    """
    seen = cut(outlines(pages))
    firsts = cut(seen.groupBy("w0", "copy").agg(F.min_by(F.struct("w1", "w2", "keys", "tree"), F.struct("w2", F.xxhash64("keys"))).alias("p")).select("w0", "p.*"))
    # The finer layouts need three pages, as two pages can agree by chance.
    level = F.explode(F.array(*[F.struct(F.col(f"w{k}").alias("w"), F.lit(2 if k == 0 else 3).alias("least")) for k in range(3)]))
    sizes = firsts.select(level.alias("x")).select("x.*").groupBy("w").agg(F.count("*").alias("of"), F.max("least").alias("least")).where("of >= least")
    held = _key_counts(firsts).where("n > 1").join(sizes, "w").where("2 * (n - 1) > of - 1")
    template = cut(held.groupBy("w").agg(F.collect_list("key").alias("keys")))
    of_layout = seen.select("w0", "w1", "w2").distinct()
    for k in range(3):
        of_layout = of_layout.join(template.select(F.col("w").alias(f"w{k}"), F.col("keys").alias(f"keys{k}")), f"w{k}", "left")
    none = F.array().cast("array<bigint>")
    constant_keys = cut(of_layout.select("w2", F.array_distinct(F.concat(*[F.coalesce(f"keys{k}", none) for k in range(3)])).alias("template")).where(F.size("template") > 0))
    # All pages count here, copies too: a layout may have no page that is the first of its copies.
    bare = _bare_trees(_join_small(seen, constant_keys, 8 * F.size("template") + 32, "inner")).groupBy("w2", "tree").agg(F.first("keys").alias("keys"))
    most = bare.select("w2", "tree", F.size("keys").alias("n"), F.explode("keys").alias("key")).groupBy("w2", "key").agg(F.max(F.struct("n", "tree")).alias("best"))
    return most.select("w2", "best.tree").distinct().groupBy("w2").agg(F.sort_array(F.collect_list("tree")).alias("trees"))


def extract(pages: DataFrame) -> DataFrame:
    """A row per row of `pages`: page_id, url, text."""
    induced = cut(wrappers(pages))
    types = dict(pages.dtypes)

    def leaves_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ws, texts, numbers, trees = [], [], [], []
            for of_host, html in zip(batch.column(2), batch.column(3), strict=True):
                root = parse(html.as_py())
                found = leaves(root)
                ws.append(layouts(root, of_host.as_py())[2])
                trees.append(signature(root))
                texts.append([t.text for t in found])
                rows: dict[tuple[int, str], int] = {}
                columns = [[t.key for t in found], [t.links for t in found], [t.main for t in found], [rows.setdefault(t.row, len(rows)) for t in found]]
                numbers.append(np.array(columns, np.uint64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _long(ws), pa.array(texts, pa.list_(pa.string())), pa.array(numbers, pa.binary()), pa.array(trees, pa.string())], ["page_id", "url", "w2", "texts", "numbers", "tree"])

    own = pages.select("page_id", "url", host(F.col("url")).alias("host"), "html").mapInArrow(leaves_of, f"page_id {types['page_id']}, url string, w2 long, texts array<string>, numbers binary, tree string")
    joined = _join_small(own, induced, F.aggregate("trees", F.lit(0), lambda n, t: n + F.length(t)), "left").select("page_id", "url", "texts", "numbers", "tree", "trees")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            shaped: dict[str, tuple[Node, set[int]]] = {}  # the wrappers of this batch
            for texts, numbers, tree, trees in zip(*batch.columns[2:], strict=True):
                keys, links, mains, rows = np.frombuffer(numbers.as_py(), np.uint64).reshape(4, -1).tolist()
                same = [False] * len(keys)
                for bare in trees.as_py() or []:
                    if bare not in shaped:
                        wrapper = from_signature(bare)
                        shape(wrapper)
                        shaped[bare] = wrapper, {leaf.key for leaf in leaves(wrapper)}
                    wrapper, wanted = shaped[bare]
                    if not wanted.isdisjoint(keys):
                        page = from_signature(tree.as_py(), lambda _, key, wanted=wanted: key in wanted)
                        shape(page)
                        for number in align(page, wrapper):
                            same[number] = True
                out.append(content(texts.as_py(), links, mains, rows, same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(each, f"page_id {types['page_id']}, url string, text string")
