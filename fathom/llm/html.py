"""Main text of web pages by wrapper induction.

Pages of one host share a wrapper. Each page's tree is aligned with that of one reference page of its host by
simple tree matching, which gives its blocks of text the places of the reference's. A text that most pages
of the host have in one place is template; what varies there is content. Elements that say what they are,
such as menus, forms, notices or comments, are left out before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import only, task, with_classes, written
from .tokens import portions

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SAYS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends these where they stand open within the nearest of the boundaries.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
_DROP = frozenset("script style noscript template head nav aside footer form iframe button select textarea input svg canvas object embed video audio menu dialog noembed noframes title".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names of class, id and role that say that an element isn't the article: alone, or as the last word of a name.
_NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "sidebar rail menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations "
    "teaser widget pagination pager toolbar login signup signin search contentinfo complementary".split()
)
#: Of these a name of several words, with one of them last, can be a part of the article: what it holds decides.
_WEAK = frozenset("search widget comment related recommended recommendations teaser rail alert login signup signin promo promotion toolbar reply respond sponsor sponsored".split())
#: Of these the first word of a name says enough where only words for parts and places follow, as in comments-list.
_FIRST = frozenset("ad ads advert adverts advertisement cookie cookies gdpr newsletter sidebar navbar breadcrumb breadcrumbs footer masthead comment comments commentlist disqus pagination".split())
_PARTS = frozenset("list item items form thread header title count counter body text content author meta slot unit bar link links group row rows column col cell card panel zone space placeholder frame label button toggle new all more".split())
#: Words before or behind a name that say something about another element, or where one stands.
_ABOUT, _STATE, _WHERE = frozenset("has have with without no not hide show is".split()), frozenset("open opened closed enabled disabled on off visible active allowed".split()), frozenset("left right top bottom box area section block container wrapper list inner outer".split())


class Node:
    __slots__ = ("tag", "says", "kids", "shape")

    def __init__(self, tag: str, says: frozenset = frozenset()):
        self.tag, self.says, self.kids, self.shape = tag, says, [], None

    def elements(self) -> list["Node"]:
        return [k for k in self.kids if isinstance(k, Node)]


def _names_noise(name: str) -> str:
    """Whether a class or id names something beside the article, as a whole or by its deciding word: noise, maybe
    (what it holds decides) or nothing."""
    words = [w.lower() for w in _SAYS.findall(name) if not w.isdigit()]
    if not words or words[0] in _ABOUT or words[-1] in _STATE:
        return ""
    first = words[0] in _FIRST and all(w in _PARTS or w in _WHERE or w in _NOISE for w in words[1:])
    while len(words) > 1 and words[-1] in _WHERE:
        words.pop()
    if first or words[-1] in _NOISE and (len(words) == 1 or words[-1] not in _WEAK):
        return "noise"
    return "maybe" if words[-1] in _NOISE else ""


def _says(attributes: str) -> frozenset:
    """Of an element's attributes: its names as they are, and whether they make it noise, header or hidden."""
    if "=" not in attributes and "hidden" not in attributes:
        return frozenset()
    said: set[str] = set()
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role", "itemprop"):
            for one in value.split():
                said.add(one.lower())
                if found := _names_noise(one):
                    said.add(f"\0{found}")
                elif name != "itemprop" and [w.lower() for w in _SAYS.findall(one)][-1:] == ["header"]:
                    said.add("\0header")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            said.add("\0hidden")
    return frozenset(said)


def parse(html: str) -> Node:
    """The element tree of a page; text is kept as strings among the children. Unclosed elements end where an
    element that can't stand in them begins, or with their parent."""
    root = Node("#root")
    stack, at = [root], 0
    for m in _MARKUP.finditer(html):
        if m.start() < at:
            continue
        if m.start() > at:
            stack[-1].kids.append(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in _BLOCK and stack[i].tag in _BLOCK:
                    break  # an inline end tag doesn't end a block
            continue
        if tag in _BLOCK or tag in _ENDS:
            ended, scope = _ENDS.get(tag, {"p"}), _SCOPE.get(tag, {"table"})
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ended or (stack[i].tag == "p" and tag in _BLOCK):
                    del stack[i:]
                elif stack[i].tag in scope or (stack[i].tag in _BLOCK and tag not in _ENDS):
                    break
        node = Node(tag, _says(m[3]))
        stack[-1].kids.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif tag not in _VOID and not m[3].endswith("/"):
            stack.append(node)
    if at < len(html):
        stack[-1].kids.append(html[at:])
    return root


def _noise(node: Node, inside: bool, lenient: bool = False) -> bool:
    """Whether an element isn't part of the article. Lenient: names and forms don't count, as the article is in one."""
    if node.tag in ("html", "body"):
        return False
    if lenient and (node.tag == "form" or not node.says.isdisjoint(("\0noise", "\0maybe", "\0header")) and "\0hidden" not in node.says):
        return False
    if "\0maybe" in node.says and not (inside and _prose(node)):
        return True
    return node.tag in _DROP or "\0hidden" in node.says or "\0noise" in node.says or (not inside and (node.tag == "header" or "\0header" in node.says))


def _prose(node: Node, least: int = 20) -> bool:
    """Whether an element has paragraphs of so many words beside links."""
    n, todo = 0, [(node, False)]
    while todo and n < least:
        top, paragraph = todo.pop()
        for k in top.kids:
            if isinstance(k, str):
                n += len(k.split()) if paragraph else 0
            elif k.tag != "a" and k.tag not in _DROP and k.says.isdisjoint(("\0noise", "\0hidden")):
                todo.append((k, paragraph or k.tag in ("p", "blockquote")))
    return n >= least


def _length(node: Node) -> int:
    n, todo = 0, [node]
    while todo:
        for k in todo.pop().kids:
            if isinstance(k, str):
                n += len(k.strip())
            elif not _noise(k, True):
                todo.append(k)
    return n


def content_root(root: Node) -> tuple[list[Node], bool]:
    """The article: all elements named so, wherever they stand, if any has text; else the main element with the most
    text, else the whole page. Where all articles are in noise, as in a page that is one
    form, that noise is looked through."""
    for lenient in (False, True):
        articles: list[Node] = []
        mains: list[Node] = []
        todo = [root]
        while todo:
            k = todo.pop()
            if k is not root:
                if _noise(k, False, lenient):
                    continue
                if k.tag == "article" or "articlebody" in k.says:
                    articles.append(k)
                    continue
                if k.tag == "main" or "main" in k.says:
                    mains.append(k)
            todo += reversed(k.elements())
        if any(_length(k) for k in articles):
            return articles, True
        if mains and _length(best := max(mains, key=_length)):
            return [best], True
    return [root], False


# Simple tree matching: two nodes match if their tags do; the children are matched in order so that most nodes
# are. What has been matched once is looked up by shape, as pages of a host repeat shapes. No walk recurses into
# the tree, so nesting may be of any depth.
_SHAPES: dict[tuple, int] = {}
_MATCHED: dict[tuple[int, int], tuple[int, tuple]] = {}
#: Cells of a table of children that are kept whole; larger ones are halved, which gives the same score.
_CELLS = 1_000_000


def ordered(root: Node) -> list[Node]:
    """All elements in page order."""
    out, todo = [], [root]
    while todo:
        out.append(todo.pop())
        todo += reversed(out[-1].elements())
    return out


def _shape(node: Node) -> int:
    if node.shape is None:
        for n in reversed(ordered(node)):
            if n.shape is None:
                n.shape = _SHAPES.setdefault((n.tag, *[k.shape for k in n.elements()]), len(_SHAPES))
    return node.shape


def _rows(w: np.ndarray, xs: np.ndarray, ys: np.ndarray, keep: bool) -> np.ndarray:
    """Best scores of all beginnings of xs (or of the whole alone) with all beginnings of ys."""
    row = np.zeros(len(ys) + 1, np.int64)
    table = [row]
    for x in xs:
        above, row = row, np.zeros(len(ys) + 1, np.int64)
        row[1:] = np.maximum.accumulate(np.maximum(above[1:], above[:-1] + w[x][ys]))
        if keep:
            table.append(row)
    return np.array(table) if keep else row


def _aligned(w: np.ndarray, xs: np.ndarray, ys: np.ndarray, x0: int = 0, y0: int = 0) -> list[tuple[int, int]]:
    """Pairs of places whose weights w[x, y] add up to the most, in order; linear in memory (Hirschberg)."""
    if not len(xs) or not len(ys):
        return []
    if len(xs) == 1 or len(xs) * len(ys) <= _CELLS:
        best, pairs, i, j = _rows(w, xs, ys, True), [], len(xs), len(ys)
        while i and j:
            if best[i, j] == best[i - 1, j]:
                i -= 1
            elif best[i, j] == best[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((x0 + i, y0 + j))
        return pairs[::-1]
    half = len(xs) // 2
    cut = int(np.argmax(_rows(w, xs[:half], ys, False) + _rows(w, xs[half:][::-1], ys[::-1], False)[::-1]))
    return _aligned(w, xs[:half], ys[:cut], x0, y0) + _aligned(w, xs[half:], ys[cut:], x0 + half, y0 + cut)


def _match(a: Node, b: Node) -> tuple[int, tuple]:
    """Number of matched nodes, and the matched pairs of element children by number."""
    if a.tag != b.tag:
        return 0, ()
    _shape(a), _shape(b)
    todo = [(a, b)]
    while todo:
        p, q = todo[-1]
        if (p.shape, q.shape) in _MATCHED:
            todo.pop()
            continue
        x, y = p.elements(), q.elements()
        # Equal children at the head and the tail are matched with each other in some best matching.
        head = 0
        while head < min(len(x), len(y)) and x[head].shape == y[head].shape:
            head += 1
        tail = 0
        while tail < min(len(x), len(y)) - head and x[-1 - tail].shape == y[-1 - tail].shape:
            tail += 1
        mx, my = x[head : len(x) - tail], y[head : len(y) - tail]
        kinds, others = {k.shape: k for k in mx}, {k.shape: k for k in my}
        equal = {k.shape: k for k in x[:head] + x[len(x) - tail :]}
        needed = [(k, k) for k in equal.values()] + [(k, o) for k in kinds.values() for o in others.values() if k.tag == o.tag]
        missing = [(k, o) for k, o in needed if (k.shape, o.shape) not in _MATCHED]
        if missing:
            todo += missing
            continue
        todo.pop()
        pairs = [(i, i) for i in range(head)]
        if mx and my:
            w = np.array([[_MATCHED[k, o][0] if n.tag == m.tag else 0 for o, m in others.items()] for k, n in kinds.items()])
            at, to = {k: i for i, k in enumerate(kinds)}, {k: i for i, k in enumerate(others)}
            pairs += _aligned(w, np.array([at[k.shape] for k in mx]), np.array([to[k.shape] for k in my]), head, head)
        pairs += [(len(x) - tail + i, len(y) - tail + i) for i in range(tail)]
        _MATCHED[p.shape, q.shape] = (1 + sum(_MATCHED[x[i].shape, y[j].shape][0] for i, j in pairs), tuple(pairs))
    return _MATCHED[a.shape, b.shape]


def numbered(root: Node) -> dict[int, int]:
    """Places of a reference page: its elements by number, in page order."""
    return {id(n): i for i, n in enumerate(ordered(root))}


def places(page: Node, reference: Node, number: dict[int, int]) -> dict[int, int]:
    """For each element of a page that is matched, the place of its match in the reference."""
    out: dict[int, int] = {}
    todo = [(page, reference)]
    while todo:
        a, b = todo.pop()
        out[id(a)] = number[id(b)]
        x, y = a.elements(), b.elements()
        todo += [(x[i], y[j]) for i, j in _match(a, b)[1]]
    return out


def blocks(root: Node, place: dict[int, int]) -> list[tuple[int, str]]:
    """The place (-1: none) and text of each block of the article, in page order. Outside an article, items of
    lists and tables that are links for the most part are menus."""
    tops, inside = content_root(root)
    out: list[tuple[int, str]] = []
    held: list[str] = []
    linked = 0

    def flush(node: Node) -> None:
        nonlocal linked
        text = " ".join(unescape("".join(held)).split())
        if text and not (not inside and node.tag in ("li", "dt", "dd", "td", "th") and linked >= 0.8 * len(text)):
            out.append((place.get(id(node), -1), text))
        held.clear()
        linked = 0

    for top in tops:
        # A frame: children left, element, the block that its text belongs to, headings only, text held before.
        frames = [(iter(top.kids), top, top, False, 0)]
        while frames:
            kids, node, block, headings, before = frames[-1]
            k = next(kids, None)
            if k is None:
                frames.pop()
                if node.tag in _BLOCK or not frames:
                    flush(node)
                elif node.tag == "a":
                    linked += sum(map(len, held)) - before
            elif isinstance(k, str):
                if not headings:
                    held.append(k)
            elif k.tag in ("br", "hr"):
                held.append(" ")
            elif _noise(k, inside):
                if k.tag in _BLOCK:
                    flush(block)
            else:
                only = (headings or k.tag == "header") and k.tag not in _HEADINGS
                if k.tag in _BLOCK:
                    flush(block)
                frames.append((iter(k.kids), k, k if k.tag in _BLOCK else block, only, sum(map(len, held)) if k.tag == "a" else 0))
    return out


_BLOCKS = "array<struct<place:int,hash:long,text:string>>"


def extract(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    share: float = 0.6,
    least_pages: int = 4,
    max_reference_bytes: int = 64 << 20,
    broadcast_rows: int = 200_000,
) -> DataFrame:
    """id, url, text, n_chars of each page's main text: blocks in page order, joined by an empty line.

    A text is template if at least ``share`` of a host's different pages, ``least_pages`` of them or more,
    have it in the same place. It goes from all pages of which anything varies, however short that is; a page
    that is template throughout keeps its text. Copies of one page, in any number, count as one page. Null and empty pages have no text; pages whose URL is
    null have no host and no template; repeated rows stay. All pages are aligned, counted and extracted whole.

    One reference page a host is chosen by hash, a page of some length if there is one. The references go to the workers together while they are
    small (measured), else by a join that keeps hosts of many pages out of the shuffle; templates likewise.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.xxhash64(html_col).alias("h"), F.col(html_col).alias("html"))
    references = written(rows.where("host <> '' and html is not null").groupBy("host").agg(F.min_by("html", F.struct(F.length("html") < 200, "h", "html")).alias("reference")), "references")
    size = references.agg(F.sum(F.octet_length("reference"))).first()[0] or 0
    if size <= max_reference_bytes:
        sent = pages.sparkSession.sparkContext.broadcast({r["host"]: r["reference"] for r in references.toLocalIterator()})
        rows = rows.withColumn("reference", F.lit(None).cast("string"))
    else:
        sent, known = None, F.col("host") != ""
        known = known & F.col("html").isNotNull()
        rows = with_classes(rows.where(known), references, "host").unionByName(rows.where(~known).withColumn("reference", F.lit(None).cast("string")))

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("shapes", _SHAPES, _MATCHED)
        trees: dict[str, tuple[Node, dict[int, int]]] = {}
        kind = pa.list_(pa.struct([("place", pa.int32()), ("hash", pa.int64()), ("text", pa.string())]))
        for batch in batches:
            for part in portions(batch, 4):
                out = []
                for host, html, reference in zip(part.column(2).to_pylist(), part.column(4).to_pylist(), part.column(5).to_pylist()):
                    reference = sent.value.get(host) if sent else reference
                    page, place = parse(html or ""), {}
                    if len(_SHAPES) > 300_000 or len(_MATCHED) > 300_000:
                        _SHAPES.clear(), _MATCHED.clear(), trees.clear()
                    if reference is not None:
                        if host not in trees:
                            if len(trees) > 2_000:
                                trees.clear()
                            tree = parse(reference)
                            trees[host] = (tree, numbered(tree))
                        place = places(page, *trees[host])
                    out.append([{"place": at, "hash": xxhash.xxh3_64_intdigest(text) - (1 << 63), "text": text} for at, text in blocks(page, place)])
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(out, kind)], ["id", "url", "host", "h", "blocks"])

    cut = written(rows.select("id", "url", "host", "h", "html", "reference").mapInArrow(run, pages.select(F.col(id_col).alias("id")).schema.add("url", "string").add("host", "string").add("h", "long").add("blocks", _parsed(_BLOCKS))), "blocks")
    placed = cut.where("host <> ''").select("host", "h", F.expr("transform(filter(blocks, b -> b.place >= 0), b -> struct(b.place as place, b.hash as hash))").alias("at"))
    different = placed.groupBy("host", "h").agg(F.first("at").alias("at"))
    different = written(different, "different-pages")
    counts = different.groupBy("host").agg(F.count("*").alias("pages"))
    seen = different.select("host", F.explode(F.array_distinct("at")).alias("at")).groupBy("host", "at").agg(F.count("*").alias("n"))
    fixed = seen.join(counts, "host").where((F.col("pages") >= least_pages) & (F.col("n") >= F.col("pages") * share))
    template = written(fixed.groupBy("host").agg(F.collect_list("at").alias("template")), "templates")  # at most the places of one page, by 1 / share
    if template.count() <= broadcast_rows:
        out = cut.join(F.broadcast(template), "host", "left")
    else:  # every host as a class, those of many pages apart from the rest
        out = with_classes(cut, cut.select("host").distinct().join(template, "host", "left"), "host")
    varying = F.expr("filter(blocks, b -> not coalesce(array_contains(template, struct(b.place as place, b.hash as hash)), false))")
    kept = F.when(F.size("varying") > 0, F.col("varying")).otherwise(F.col("blocks"))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")
    return out.withColumn("varying", varying).select(F.col("id").alias(id_col), F.col("url").alias(url_col), text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def _parsed(ddl: str):
    from pyspark.sql import types as T

    return T._parse_datatype_string(ddl)
