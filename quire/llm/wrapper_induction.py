"""Main text of web pages by wrapper induction over the pages of a host.

1. A page becomes a tree of its blocks. Neighbours of one shape are one node that repeats, so that
   pages of one template have few different trees, and each text of a page has a node of it.
2. Each different tree of a host is aligned with the host's most frequent one by simple tree
   matching: nodes match if tag and role are equal, in order, for the greatest number of matching
   nodes (twice as many for equal classes). Nodes that match nothing are named by their path.
3. Over the host's pages, copies counted once, a node or a text of a node that is the same on nine
   of ten pages, and on five at least, is template; what varies is a slot.
4. Of the slots, those inside the article are content: inside `article` or `main`, or else inside the
   deepest node, within one named as its holder if there is one, that holds three fifths of the host's
   varying text that isn't in links and says nothing beside that, with the heading. Left out are nodes that tag, role, class or id name as something else, and lists of
   links. Template texts inside the article go only where most of the article varies; where most of
   it is the same everywhere, the pages are copies and tell nothing about the template.

Trees and counts meet by host in sums, never as pages; only the few different trees of a host are
compared, each on its own with the most frequent one.

A null or empty page has an empty text; a null url belongs to a host without name; repeated rows
each get their text; extra columns are left out; an empty table gives an empty result. Elements
nested deeper than 200 are taken as part of the 200th; nothing of a page is cut off.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

DEPTH = 200
#: A text is template on this share of a host's pages, and on as many pages at least.
SHARE, LEAST = 0.9, 5
#: The deepest node with this share of the text is taken for the article; a list with this share of links isn't content.
HOLDS, LINKS = 0.6, 0.8

# Elements of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
_GONE = frozenset("head script style title textarea xmp iframe noembed noframes template noscript svg math object canvas audio video map select button datalist label legend progress meter".split())
_BLOCKS = frozenset(
    "html body main article section div nav header footer aside form fieldset dialog menu details summary address hgroup search p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd blockquote pre table caption thead tbody tfoot tr td th figure figcaption center hr".split()
)
_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd blockquote pre table figure #text tr td th".split())
_CLOSES_P = _BLOCKS - frozenset("html body caption thead tbody tfoot tr td th li dt dd summary".split())
#: What a start tag closes, and where the search for it ends.
_SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_SAME |= {x: ({"thead", "tbody", "tfoot"}, {"table"}) for x in ("thead", "tbody", "tfoot")}
_WALLS = frozenset("td th caption html".split())

# Words of classes, ids and roles, and tags, that name what isn't the article.
_ROLES = {
    "nav": "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager skiplink toc",
    "header": "header masthead topbar banner",
    "footer": "footer colophon copyright contentinfo",
    "side": "side sidebar sidenav aside complementary rail widget widgets related recommended recommendations trending popular",
    "ad": "ad ads advert adverts advertisement advertisements advertising adslot adbox adunit sponsor sponsored promo promotion adsense outbrain taboola",
    "notice": "cookie cookies consent gdpr notice notices alert alertdialog dialog modal popup overlay newsletter subscribe subscription paywall toast",
    "share": "share sharing social follow",
    "form": "form search searchbox login signup signin",
    "comment": "comment comments commentlist disqus respond responses reply replies discussion feedback",
}
_NAMED = {word: role for role, words in _ROLES.items() for word in words.split()}
#: Longer words that begin so name the same (cookiebar, commentlist).
_BEGIN = tuple((x, _NAMED[x]) for x in ("advert", "breadcrumb", "comments", "cookie", "newsletter", "sidebar", "sponsor"))
#: Classes and ids of the node that holds the article, and headings of what readers say.
_HOLDERS = frozenset("article content entry main post story".split())
_HEADED = re.compile(r"\W*\d*\W*(?:reader |user )?(?:comments?|kommentare|commentaires|comentarios)\W*\d*\W*", re.I)
_TAGS = {"nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "side", "form": "form", "search": "form", "fieldset": "form", "dialog": "notice"}

_TOKEN = re.compile(
    r"""<!--(?:.*?--!?>|.*\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|<[!?/][^>]*>|<[!?/a-zA-Z][^>]*\Z""",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@lru_cache(maxsize=4096)
def _described(tag: str, attrs: str) -> tuple[str, str, bool]:
    """(name for alignment, role, hidden) of an element."""
    found = {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(attrs)} if attrs else {}
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    words = [w.lower() for k in ("role", "class", "id") for w in _PART.findall(found.get(k, ""))]
    role = _TAGS.get(tag, "") or next((_NAMED[w] for w in words if w in _NAMED), "") or next((role for w in words for begin, role in _BEGIN if w.startswith(begin)), "")
    return re.sub("[0-9]+", "#", " ".join(sorted({w for w in (found.get("class", "") + " " + found.get("id", "")).lower().split()}))), role, hidden


class Node:
    """An element of blocks, or a text (tag `#text`)."""

    __slots__ = ("tag", "name", "role", "kids", "text", "links", "shape", "has")

    def __init__(self, tag: str, name: str = "", role: str = "", text: str = "", links: int = 0):
        self.tag, self.name, self.role, self.kids, self.text, self.links, self.shape, self.has = tag, name, role, [], text, links, 0, frozenset()


def parse(page: str) -> Node:
    """The tree of a page's blocks with a text."""
    root = Node("html")
    stack = [root]
    gone: list[str] = []
    # The text of the block that is being read, and how much of it is in a link.
    parts: list[tuple[str, bool]] = []
    link, at, size = False, 0, len(page)

    def flush() -> None:
        if parts:
            text = " ".join("".join(x for x, _ in parts).split())
            if text:
                linked = sum(len(" ".join(x.split())) for x, inside in parts if inside)
                stack[-1].kids.append(Node("#text", text=text, links=min(linked, len(text))))
            parts.clear()

    def close(tags: set | frozenset, walls: set | frozenset) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                flush()
                del stack[k:]
                return
            if stack[k].tag in walls:
                return

    while at < size:
        found = _TOKEN.search(page, at)
        begin, end = found.span() if found else (size, size)
        if begin > at and not gone:
            text = page[at:begin]
            parts.append((html.unescape(text) if "&" in text else text, link))
        at = end
        if not found:
            break
        if found["data"] is not None and not gone:
            parts.append((found["data"], link))
        tag = found["tag"] or found["tag2"]
        if not tag:
            continue
        tag, closing = tag.lower(), bool(found["end"] or found["end2"])
        if closing:
            if gone:
                if tag == gone[-1]:
                    gone.pop()
                elif tag in gone:
                    del gone[gone.index(tag) :]
                continue
            if tag == "a":
                link = False
            if tag not in ("html", "body"):
                close({tag}, _WALLS - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else {"html"})
            continue
        if tag in _RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else size
            continue
        attrs = found["attrs"] if found["tag"] else found["attrs2"]
        if gone:
            if tag not in _VOID and tag == gone[-1] and not attrs.endswith("/"):
                gone.append(tag)
            elif tag in ("body", "article", "main", "nav", "div") and gone == ["head"]:
                gone.pop()
            if gone:
                continue
        if tag == "br":
            parts.append((" ", link))
            continue
        if tag == "a":
            link = True
        if tag in _VOID:
            if tag == "hr":
                close({"p"}, _WALLS)
                flush()
            continue
        name, role, hidden = _described(tag, attrs) if attrs else ("", _TAGS.get(tag, ""), False)
        if tag in _GONE or hidden:
            if not attrs.endswith("/"):
                gone.append(tag)
            continue
        if tag in ("html", "body"):
            continue
        if tag in _CLOSES_P:
            close({"p"}, _WALLS)
        if tag in _SAME:
            close(*_SAME[tag])
        if tag in _BLOCKS or role or "-" in tag:
            flush()
            if len(stack) < DEPTH and not attrs.endswith("/"):
                node = Node(tag, name, role)
                stack[-1].kids.append(node)
                stack.append(node)
    flush()
    return root


#: What an element has in itself for its role not to count.
_HOLDS_ARTICLE = {"main", "h1", "article"}


def _settle(node: Node, inside: bool = False) -> bool:
    """Leaves out nodes without a text, notes what each holds, and takes away the roles of those that hold the article; tells whether a text is left."""
    here = inside or node.tag in ("article", "main")
    node.kids = [kid for kid in node.kids if _settle(kid, here and not node.role)]
    if not node.role and node.tag in ("section", "div") and len(node.kids) > 1 and node.kids[0].tag in ("h2", "h3", "h4", "h5", "h6") and len(node.kids[0].kids) == 1 and _HEADED.fullmatch(node.kids[0].kids[0].text):
        node.role = "comment"
    node.has = frozenset({node.tag} & _HOLDS_ARTICLE).union(*(kid.has for kid in node.kids if not kid.role))
    if node.role == "header" and (here or node.has & {"main", "article"}):
        node.role = ""
    elif node.role == "comment":
        node.role = "" if "main" in node.has or {"h1", "article"} <= node.has else node.role
    elif node.role == "side":
        node.role = "" if node.has & {"main", "h1"} else node.role
    elif node.role and node.role != "header" and node.has:
        node.role = ""
    return node.tag == "#text" or bool(node.kids)


class Skeleton:
    """A page's tree in which neighbours of one shape are one node; nodes are numbered from the root on, parents first."""

    def __init__(self, root: Node):
        self.shapes: dict[tuple, int] = {}
        self.nodes: list[list] = []
        self.blocks: list[tuple[int, str, int]] = []
        self._shape(root)
        self._number(root, -1, {})

    def _kept(self, node: Node) -> list[list[Node]]:
        """Children by the node that they share."""
        out: list[list[Node]] = []
        flow: dict[int, list[Node]] = {}
        for kid in node.kids:
            if kid.tag in _FLOW and not kid.role:
                if kid.shape in flow:
                    flow[kid.shape].append(kid)
                    continue
                flow[kid.shape] = [kid]
                out.append(flow[kid.shape])
                continue
            flow = {}
            if out and out[-1][0].shape == kid.shape:
                out[-1].append(kid)
            else:
                out.append([kid])
        return out

    def _shape(self, node: Node) -> None:
        for kid in node.kids:
            self._shape(kid)
        key = (node.tag, node.name, node.role, tuple(group[0].shape for group in self._kept(node)))
        node.shape = self.shapes.setdefault(key, len(self.shapes) + 1)

    def _number(self, node: Node, parent: int, known: dict) -> None:
        """Numbers a node as its twins under the same parent are numbered; its blocks come in page order."""
        number = known.get((parent, node.shape, node.tag))
        if number is None:
            number = known[parent, node.shape, node.tag] = len(self.nodes)
            self.nodes.append([parent, node.tag, node.name, node.role])
        if node.tag == "#text":
            self.blocks.append((number, node.text, node.links))
            return
        groups = {id(kid): k for k, group in enumerate(self._kept(node)) for kid in group}
        for kid in node.kids:
            slot = (number, groups[id(kid)])
            self._number(kid, number, known.setdefault(slot, {}))

    def text(self) -> str:
        return json.dumps(self.nodes, ensure_ascii=False, separators=(",", ":"))


# --- alignment ---


def _tree(nodes: list[list]) -> tuple[list[list[int]], list[int]]:
    """Children and shape of each node; equal shapes within `_SHAPES` are equal trees."""
    kids: list[list[int]] = [[] for _ in nodes]
    for k, (parent, *_) in enumerate(nodes):
        if parent >= 0:
            kids[parent].append(k)
    shapes = [0] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        shapes[k] = xxhash.xxh3_64_intdigest(repr((nodes[k][1:], [shapes[x] for x in kids[k]])).encode())
    return kids, shapes


#: Numbers of the table of a match that are held at once; of a larger one, rows are made again from a row halfway.
_TABLE = 1 << 20
#: Gains, and matches of nodes, that are kept so as not to be found again; none of these numbers changes what is found.
_GAINS, _KNOWN = 1 << 24, 100_000


def _next(row: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """The row of the table that follows, given what the next node gains with each of the other side."""
    out = row.copy()
    np.maximum(out[1:], row[:-1] + gain, out=out[1:])
    return np.maximum.accumulate(out)


def _best_pairs(gains: Callable[[int], np.ndarray], n: int, m: int) -> tuple[int, list[tuple[int, int]]]:
    """The greatest sum of gains of pairs that rise on both sides, and the pairs, the last first. `gains`: of one of n nodes with each of m."""
    pairs: list[tuple[int, int]] = []

    def trace(row: np.ndarray, low: int, high: int, j: int) -> int:
        """Follows the table back from row `high` and column j to row `low`, which is given."""
        if high - low > 1 and (high - low) * (j + 1) > _TABLE:
            middle, half = (low + high) // 2, row[: j + 1]
            for i in range(low, middle):
                half = _next(half, gains(i)[:j])
            j = trace(half, middle, high, j)
            return trace(row, low, middle, j)
        table = [row[: j + 1]]
        for i in range(low, high):
            table.append(_next(table[-1], gains(i)[:j]))
        i = high
        while i > low and j:
            now, before = table[i - low], table[i - low - 1]
            if now[j] == before[j]:
                i -= 1
            elif now[j] == now[j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
        return j

    first = np.zeros(m + 1, np.int64)
    trace(first, 0, n, m)
    return sum(int(gains(i)[j]) for i, j in pairs), pairs


def align(ours: list[list], theirs: list[list]) -> list[int]:
    """For each of our nodes the one of theirs that simple tree matching gives it, or -1."""
    kids, shapes = _tree(ours)
    kids2, shapes2 = _tree(theirs)
    out = [-1] * len(ours)
    known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def same(a: int, b: int) -> bool:
        return ours[a][1] == theirs[b][1] and ours[a][3] == theirs[b][3]

    def size(a: int) -> int:
        return 2 + sum(size(x) for x in kids[a])

    def gain(a: int, b: int) -> int:
        if not same(a, b):
            return 0
        return match(a, b)[0] if kids[a] and kids2[b] else 1 + (ours[a][2] == theirs[b][2])

    def match(a: int, b: int) -> tuple[int, list[tuple[int, int]]]:
        """Number of matching nodes below and with a pair of matching nodes, and the pairs of their children."""
        if (a, b) in known:
            return known[a, b]
        left, right = kids[a], kids2[b]
        head = 0
        while head < min(len(left), len(right)) and shapes[left[head]] == shapes2[right[head]]:
            head += 1
        tail = 0
        while tail < min(len(left), len(right)) - head and shapes[left[-1 - tail]] == shapes2[right[-1 - tail]]:
            tail += 1
        pairs = [(left[k], right[k]) for k in range(head)] + [(left[-1 - k], right[-1 - k]) for k in range(tail)]
        total = 1 + (ours[a][2] == theirs[b][2]) + sum(size(x) for x, _ in pairs)
        left, right = left[head : len(left) - tail], right[head : len(right) - tail]
        # Nodes of one shape gain the same, so that only different shapes are matched, and a row is made for each of them.
        stands = {shapes2[y]: y for y in reversed(right)}
        order = {shape: k for k, shape in enumerate(stands)}
        place = np.array([order[shapes2[y]] for y in right], np.int64)
        rows: dict[int, np.ndarray] = {}

        def gains(i: int) -> np.ndarray:
            x = left[i]
            if shapes[x] not in rows:
                if (len(rows) + 1) * len(stands) > _GAINS:
                    rows.clear()
                held = max(len(known), _KNOWN)
                rows[shapes[x]] = np.array([gain(x, y) for y in stands.values()], np.int32)
                while len(known) > held:  # they are found again where they are needed
                    known.popitem()
            return rows[shapes[x]][place]

        if left and right:
            best, met = _best_pairs(gains, len(left), len(right))
            total += best
            pairs += [(left[i], right[j]) for i, j in met]
        known[a, b] = total, pairs
        return known[a, b]

    todo = [(0, 0)] if ours and theirs and same(0, 0) else []
    while todo:
        a, b = todo.pop()
        out[a] = b
        todo += match(a, b)[1]
    return out


def names(ours: list[list], theirs: list[list]) -> list[int]:
    """Name of each node within its host: the number of its match, or else, below zero, a hash of its path."""
    out: list[int] = []
    for (parent, *what), match in zip(ours, align(ours, theirs), strict=True):
        out.append(match if match >= 0 else -1 - (xxhash.xxh3_64_intdigest(repr((out[parent] if parent >= 0 else -1, what)).encode()) >> 2))
    return out


# --- what is content ---


def article(nodes: list[list], mass: list[float], linked: list[float], template: list[bool]) -> list[bool]:
    """Whether each node is in the article. `mass` is the host's varying text of a node outside of links, `linked` the share of links in all of its text."""
    n = len(nodes)
    kids: list[list[int]] = [[] for _ in nodes]
    out_of = [False] * n
    depth_first = range(n - 1, -1, -1)
    for k, (parent, _, _, role) in enumerate(nodes):
        out_of[k] = bool(role) or parent >= 0 and out_of[parent]
        if parent >= 0:
            kids[parent].append(k)
    weight = [0.0 if out else m for m, out in zip(mass, out_of, strict=True)]
    for k in depth_first:
        if nodes[k][0] >= 0:
            weight[nodes[k][0]] += weight[k]

    def outermost(tag: str) -> list[int]:
        found = [k for k in range(n) if nodes[k][1] == tag and not out_of[k]]
        above = set()
        for k in found:
            up = nodes[k][0]
            while up >= 0 and up not in above:
                if nodes[up][1] == tag:
                    above.add(k)
                    break
                up = nodes[up][0]
        return [k for k in found if k not in above]

    articles, mains = outermost("article"), outermost("main")
    if articles and (not mains or 2 * sum(weight[k] for k in articles) >= sum(weight[k] for k in mains)):
        regions = articles
    elif mains:
        regions = mains
    else:
        named = [k for k in range(n) if not out_of[k] and _HOLDERS & set(_PART.findall(nodes[k][2])) and 5 * weight[k] >= 2 * weight[0] > 0]
        at = max(named, key=lambda k: (weight[k], k), default=0)
        # A node that says something itself is the article, even if a part of it holds most of the text.
        while 20 * sum(weight[k] for k in kids[at] if nodes[k][1] in _FLOW) < weight[at] or not weight[at]:
            down = [k for k in kids[at] if nodes[k][1] not in _FLOW and not out_of[k] and weight[k] >= HOLDS * weight[at] and weight[k] > 0]
            if not down:
                break
            at = max(down, key=lambda k: weight[k])
        regions = [at, *(k for k in range(n) if nodes[k][1] == "h1" and not out_of[k])]
    inside = [False] * n
    listed = [False] * n
    for k in range(n):
        parent = nodes[k][0]
        inside[k] = not out_of[k] and (k in regions or parent >= 0 and inside[parent])
        listed[k] = nodes[k][1] in ("li", "dd", "dt") or parent >= 0 and listed[parent]
    return [x and nodes[k][1] == "#text" and not template[k] and not (listed[k] and linked[k] >= LINKS) for k, x in enumerate(inside)]


# --- Spark ---

_PARSED = "page_id bigint, url string, host string, tree bigint, skeleton string, page bigint, blocks array<struct<slot:int,text:string,links:int,fresh:boolean>>"


def _signed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def parsed(pages: DataFrame) -> DataFrame:
    """Tree and blocks of each page (page_id, url, host, html)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        trees, skeletons, hashes, blocks = [], [], [], []
        for page in batch.column(3).to_pylist():
            root = parse(page or "")
            _settle(root)
            made = Skeleton(root)
            text = made.text()
            trees.append(_signed(text))
            skeletons.append(text)
            seen: set[tuple[int, str]] = set()
            rows = []
            for slot, words, links in made.blocks:
                rows.append({"slot": slot, "text": words, "links": links, "fresh": (slot, words) not in seen})
                seen.add((slot, words))
            blocks.append(rows)
            hashes.append(_signed(repr([(slot, words) for slot, words, _ in made.blocks])))
        kind = pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string()), ("links", pa.int32()), ("fresh", pa.bool_())]))
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(trees, pa.int64()), pa.array(skeletons, pa.string()), pa.array(hashes, pa.int64()), pa.array(blocks, kind)], ["page_id", "url", "host", "tree", "skeleton", "page", "blocks"]
        )

    return c.map_rows(pages, run, _PARSED)


def _joined(big: DataFrame, small: DataFrame, on: list[str], text: str, how: str = "inner") -> DataFrame:
    """Join that broadcasts `small` only if the bytes of its longest column and its rows are counted to be few."""
    n, size = small.agg(F.count("*"), F.coalesce(F.sum(F.length(F.col(text).cast("string"))), F.lit(0))).first()
    return big.join(F.broadcast(small) if n * 64 + 4 * size <= 4 * c.BROADCAST_BYTES else small.hint("merge"), on, how)


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, tree, keep, template): for each tree of a host which of its slots are content, and the template texts (slot, hash) in them."""
    trees = c.materialise(pages.groupBy("host", "tree").agg(F.count("*").alias("n"), F.first("skeleton").alias("skeleton")))
    usual = trees.groupBy("host").agg(F.max(F.struct("n", "tree", "skeleton")).alias("u")).select("host", F.col("u.skeleton").alias("usual"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [names(json.loads(ours), json.loads(theirs)) for ours, theirs in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.list_(pa.int64()))], ["host", "tree", "n", "skeleton", "nodes"])

    paired = _joined(trees, c.materialise(usual), ["host"], "usual").select("host", "tree", "n", "skeleton", "usual").repartition("host", "tree")
    named = c.materialise(c.map_rows(paired, run, "host string, tree bigint, n bigint, skeleton string, nodes array<bigint>"))
    # Copies of a page share one vote; they are told apart by their hash, so that blocks needn't be shuffled for it.
    copies = c.materialise(pages.groupBy("host", "tree", "page").agg(F.count("*").alias("copies")))
    hosts = copies.groupBy("host").agg(F.count("*").alias("pages"))
    several = copies.filter("copies > 1")
    slim = F.transform("blocks", lambda b: F.struct(b["slot"].alias("slot"), F.xxhash64(b["text"]).alias("h"), F.length(b["text"]).alias("n"), b["links"].alias("links"), b["fresh"].cast("int").alias("fresh")))
    voting = c.join_small(pages.select("host", "tree", "page", slim.alias("blocks")), several, ["host", "tree", "page"], "left")
    leaves = voting.select("host", "tree", (F.lit(1.0) / F.coalesce("copies", F.lit(1))).alias("vote"), F.explode("blocks").alias("b")).select("host", "tree", "vote", "b.*")
    votes = [F.round(F.sum(F.col(x) * F.col("vote"))).cast("bigint").alias(y) for x, y in (("fresh", "pages"), ("n", "n"), ("links", "links"))]
    texts = leaves.groupBy("host", "tree", "slot", "h").agg(*votes)
    slots = named.select("host", "tree", F.posexplode("nodes").alias("slot", "node"))
    texts = _joined(texts, slots, ["host", "tree", "slot"], "node").groupBy("host", "node", "h").agg(*[F.sum(x).alias(x) for x in ("pages", "n", "links")])
    texts = c.materialise(_joined(texts, hosts.withColumnRenamed("pages", "all"), ["host"], "all").withColumn("template", F.col("pages") >= F.greatest(F.lit(LEAST), F.ceil(F.col("all") * SHARE))))
    fixed = F.col("template").cast("bigint")
    stats = texts.groupBy("host", "node").agg(F.sum("n").alias("n"), F.sum("links").alias("links"), F.sum(F.col("n") * fixed).alias("fixed"), F.sum((F.col("n") - F.col("links")) * (1 - fixed)).alias("mass"), F.array_sort(F.collect_set(F.when(F.col("template"), F.col("h")))).alias("template"))
    # Trees are small: the stats of a tree's nodes come together in one row.
    facts = slots.join(stats, ["host", "node"]).groupBy("host", "tree").agg(F.collect_list(F.struct("slot", "n", "links", "fixed", "mass", "template")).alias("facts"))

    def decide(batch: pa.RecordBatch) -> pa.RecordBatch:
        keeps, templates = [], []
        for skeleton, facts_ in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            nodes = json.loads(skeleton)
            of = {f["slot"]: f for f in facts_ or []}
            mass = [float(of[k]["mass"]) if k in of else 0.0 for k in range(len(nodes))]
            linked = [of[k]["links"] / max(1, of[k]["n"]) if k in of else 0.0 for k in range(len(nodes))]
            keep = article(nodes, mass, linked, [False] * len(nodes))
            total, fixed_ = sum(of[k]["n"] for k in of if keep[k]), sum(of[k]["fixed"] for k in of if keep[k])
            listed = []
            if 2 * fixed_ < total:
                heads = {k for k, node in enumerate(nodes) if node[0] >= 0 and nodes[node[0]][1] == "h1"}
                listed = [{"slot": k, "h": h} for k in of if keep[k] and k not in heads for h in of[k]["template"]]
            keeps.append(keep)
            templates.append(listed)
        kind = pa.list_(pa.struct([("slot", pa.int32()), ("h", pa.int64())]))
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keeps, pa.list_(pa.bool_())), pa.array(templates, kind)], ["host", "tree", "keep", "template"])

    told = named.select("host", "tree", "skeleton").join(facts, ["host", "tree"], "left")
    return c.map_rows(told, decide, "host string, tree bigint, keep array<boolean>, template array<struct<slot:int,h:bigint>>")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, host, text, n_blocks): the main text of each page, and the number of its blocks that make it."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    own = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    found = c.materialise(parsed(own))
    told = c.materialise(wrappers(found))
    both = _joined(found.drop("skeleton", "page"), told, ["host", "tree"], "keep", "left")
    chosen = F.filter("blocks", lambda b: F.element_at(F.col("keep"), b["slot"] + 1) & ~F.array_contains(F.col("template"), F.struct(b["slot"].alias("slot"), F.xxhash64(b["text"]).alias("h"))))
    return both.withColumn("chosen", chosen).select("page_id", "url", "host", F.array_join(F.transform("chosen", lambda b: b["text"]), " ").alias("text"), F.size("chosen").cast("bigint").alias("n_blocks"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(c.table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


#: The given pages have one `article` each, with its text in h1 and p and no other markup but b and br, and few character references; SQL needs no more.
_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(h1|p|br)[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS x FROM a),
d AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(replace(x, '&quot;', '"'), '&quot', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, url, text, length(text)::bigint AS n_chars FROM d
"""

QUERIES = {"op13_html_extraction": op13_html_extraction}
ORACLES = {"op13_html_extraction": _SQL}
