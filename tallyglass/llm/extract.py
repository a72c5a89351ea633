"""Main text of web pages: site templates are found by hashing element subtrees and counting them per host."""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.store import looked_up, pieces, saved
from tallyglass.llm.urlfilter import host_of

#: A subtree is template if it stands on more than this share of a host's different articles; hosts with fewer are left alone.
RATIO, LEAST_PAGES = 0.5, 4
#: A shape that recurs is template if this share of its letters stands in links.
LINKED = 0.6

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul caption option optgroup select".split()
)
#: What the start of an element ends, if it is open in the same container.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"},
}
CONTAINERS = frozenset("ul ol dl table thead tbody tfoot tr td th div section article main aside nav form body html select blockquote".split())
#: What an end tag inside doesn't reach through, and the end tags that do.
WALLS = frozenset("td th article main body".split())
THROUGH = frozenset("table tr tbody article main body html thead tfoot".split())
FOREIGN = frozenset("svg path g circle rect use".split())
CLOSE_P = BLOCKS - frozenset("br body head html td th tr tbody thead tfoot caption option optgroup select title".split())
#: Elements that never hold main text.
DROPPED = frozenset(
    "head script style noscript template nav header footer aside form button select input textarea iframe svg math canvas object embed audio video dialog menu search map noembed noframes".split()
)
#: Classes, ids and roles of what is not main text, alone or joined by - or _ with one another and with PLACES.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion banner banners nav navbar navigation menu menus breadcrumb breadcrumbs "
    "header masthead footer sidebar sidebars complementary contentinfo cookie cookies consent gdpr notice notices notification alert popup popups modal overlay newsletter subscribe subscription "
    "signup login search share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond readers pagination pager toolbar widget widgets skip hidden".split()
)
#: Words beside which a mark still is one: the place, kind or part of the furniture.
PLACES = frozenset(
    "site page global main post article primary secondary top bottom left right inner outer sticky fixed mobile desktop bar box block area wrap wrapper container section list item items group links buttons button form inline thread "
    "slot slots unit units zone region rail strip row col column pane panel holder space placement placeholder google dfp law info policy message content body text user users author meta count feed tree root module".split()
)
#: A size or number in a mark, as in ad-300x250: a place like the others.
_SIZE = re.compile(r"\d+(?:x\d+)?")
#: Marks of what readers wrote, which never is the main text.
READERS = frozenset("comment comments commentlist disqus reply replies respond readers".split())
#: Elements whose recurrence inside an article is no sign of a template: prose repeats, as licences and quotations do.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption b i em strong span a code u s small sub sup mark q cite br hr img".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag: quotes count after = only.
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?""")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PIECE = re.compile(r"[-_]+")
_NUMBERS = re.compile(r"\d+")
#: Elements whose shape says nothing by itself.
SHAPELESS = PROSE | frozenset("html body head title center".split())
#: Words of marks that a heading's holder inside an article may bear.
TITLES = frozenset("header masthead banner top main page post article section content body block box area wrap wrapper container inner group".split())
#: Elements of headings.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ENDS_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_CUT_OFF = re.compile(r"<[/!a-zA-Z][^<>]*\Z")


class Node:
    __slots__ = ("children", "kind", "marks", "tag")

    def __init__(self, tag: str, marks: frozenset = frozenset(), kind: str = ""):
        self.tag, self.marks, self.kind, self.children = tag, marks, kind, []


@lru_cache(1 << 14)
def marked(token: str) -> str:
    """What a class, id or role says: "reader", "furniture" or nothing. Each of its words must be a mark or a place, and one of them a mark:
    site-header is furniture, share-price and with-sidebar are not."""
    words = [w for w in _PIECE.split(token) if w]
    if not any(w in MARKS for w in words) or not all(w in MARKS or w in PLACES or _SIZE.fullmatch(w) for w in words):
        return ""
    return "reader" if any(w in READERS for w in words) else "furniture"


def _node(tag: str, attributes: str) -> Node:
    if not attributes or ("=" not in attributes and "hidden" not in attributes.lower()):
        return Node(tag)
    marks, kind = set(), ""
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(value.strip("\"'")).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDING.search(value)):
            marks.add("hidden")
        elif name in ("class", "id", "role"):
            marks.update(value.split())
            if name == "role" and value == "main":
                kind = "main"
        elif name == "itemprop" and value == "articlebody":
            kind = "main"
    return Node(tag, frozenset(marks), kind)


class _Open:
    """The open elements, with the places of each tag and of some kinds, so that none of them has to be searched for."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.of: dict[str, list[int]] = {}
        self.blocks, self.containers, self.walls = [], [], []

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.of.setdefault(node.tag, []).append(at)
        for kind, places in ((BLOCKS, self.blocks), (CONTAINERS, self.containers), (WALLS, self.walls)):
            if node.tag in kind:
                places.append(at)

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            self.of[tag].pop()
            for kind, places in ((BLOCKS, self.blocks), (CONTAINERS, self.containers), (WALLS, self.walls)):
                if tag in kind:
                    places.pop()

    def last(self, tag: str) -> int:
        places = self.of.get(tag)
        return places[-1] if places else 0

    def end(self, tag: str) -> None:
        at = self.last(tag)
        if at and (tag in THROUGH or not self.walls or self.walls[-1] <= at):
            self.cut(at)

    def start(self, tag: str) -> None:
        """End what the start of an element ends."""
        if tag in CLOSE_P and self.blocks and self.last("p") == self.blocks[-1]:
            self.cut(self.blocks[-1])
        ends = ENDS.get(tag)
        while ends:
            at = max(self.last(t) for t in ends)
            wall = next((k for k in reversed(self.containers) if self.stack[k].tag not in ends), 0)
            if at <= wall:
                return
            self.cut(at)
            if tag not in ("tr", "tbody", "thead", "tfoot"):
                return


def parse(text: str) -> Node:
    """A tree of elements and strings, in time linear in the text. Unclosed, misnested and cut-off markup is taken as browsers mostly do, but a
    quote that never ends ends with its tag."""
    root = Node("#root")
    open_, at, size = _Open(root), 0, len(text)
    last_gt, quotes = text.rfind(">"), True

    def add(x: str) -> None:
        if x:
            open_.stack[-1].children.append(x)

    done = 0  # text before it is in the tree
    while 0 <= (at := text.find("<", at)) <= last_gt:
        if text.startswith("<!--", at):
            end = text.find("-->", at + 4)
            add(text[done:at])
            at = done = end + 3 if end >= 0 else size
            continue
        if text[at + 1] in "!?":
            add(text[done:at])
            at = done = text.find(">", at) + 1
            continue
        m = _TAG.match(text, at)
        if not m:
            at += 1
            continue
        rest = _REST.match(text, m.end()) if quotes else None
        if not rest:
            quotes = False  # one of them never ends; from here on they don't count, or each tag would look for its end anew
        end = rest.end() if rest else text.find(">", m.end()) + 1
        if not end:
            break
        add(text[done:at])
        tag, attributes = m[2].lower(), text[m.end() : end - 1]
        at = done = end
        if m[1]:
            open_.end(tag)
            continue
        open_.start(tag)
        node = _node(tag, attributes)
        open_.stack[-1].children.append(node)
        if tag in RAW:
            close = _ENDS_RAW[tag].search(text, at) if tag != "plaintext" else None
            stop = close.start() if close else size
            if tag in ("title", "textarea", "xmp", "plaintext"):
                node.children.append(text[at:stop])
            at = done = (text.find(">", stop) + 1 or size) if close else size
        elif tag not in VOID and not (tag in FOREIGN and attributes.endswith("/")):
            open_.push(node)
    rest = text[done:]
    cut = _CUT_OFF.search(rest)  # a tag that the page's end cuts off
    add(rest[: cut.start()] if cut else rest)
    return root


def _walk(tree: Node):
    """Each node under tree before those inside it, with the one that holds it."""
    todo = [(x, tree) for x in reversed(tree.children) if isinstance(x, Node)]
    while todo:
        x, holder = todo.pop()
        yield x, holder
        todo.extend((y, x) for y in reversed(x.children) if isinstance(y, Node))


def _says(node: Node) -> str:
    found = {marked(m) for m in node.marks}
    return "reader" if "reader" in found else "furniture" if "furniture" in found else ""


def roots(tree: Node) -> list[Node]:
    """The outermost articles that are in no page furniture; else main elements; else articles in furniture; else the whole tree.

    What elements like nav and aside hold is never main text, nor what readers wrote. Forms, and furniture told by its marks, give way to the
    articles and main elements that they hold, if there are no others."""
    plain: list[Node] = []
    in_marked: list[Node] = []
    mains: list[Node] = []
    state: dict[int, str] = {id(tree): ""}  # "": outside all; marked: in marked furniture; in: in an article or what is left out
    inner: dict[int, bool] = {id(tree): False}
    for x, holder in _walk(tree):
        above = state[id(holder)]
        inner[id(x)] = inner[id(holder)]
        if above == "in" or (x.tag in DROPPED and x.tag != "form"):
            state[id(x)] = "in"
            continue
        says = "furniture" if x.tag == "form" else _says(x) if x.tag not in ("html", "body", "main") else ""
        if says == "reader":
            state[id(x)] = "in"
        elif x.tag == "article":
            (in_marked if above or says else plain).append(x)
            state[id(x)] = "in"
        else:
            state[id(x)] = above or says
            if (x.tag == "main" or x.kind == "main") and not inner[id(x)]:
                mains.append(x)
                inner[id(x)] = True
    return plain or mains or in_marked or [tree]


def _hashes(tree: Node) -> list[tuple[Node, int]]:
    """Each subtree with its hash: of its tag, marks, text without outer white space and subtrees' hashes."""
    out: list[tuple[Node, int]] = []
    of: dict[int, bytes] = {}
    for node in [*reversed([x for x, _ in _walk(tree)]), tree]:
        h = xxhash.xxh64(node.tag)
        for m in sorted(node.marks):
            h.update("\x01" + m)
        for x in node.children:
            if isinstance(x, Node):
                h.update(b"\x02" + of.pop(id(x)))
            elif x := " ".join(x.split()):
                h.update("\x03" + x)
        value = h.intdigest() - (1 << 63)
        of[id(node)] = value.to_bytes(8, "little", signed=True)
        out.append((node, value))
    return out


def _shapes(tree: Node) -> list[tuple[Node, int, int, int]]:
    """Each block element with the hash of its shape (tag, marks without numbers, the shapes of the blocks inside, each once; no text), the letters of its text and those in links."""
    out = []
    text: dict[int, int] = {}
    link: dict[int, int] = {}
    inside: dict[int, set[bytes]] = {}
    for node in reversed([x for x, _ in _walk(tree)]):
        if node.tag in DROPPED and node.tag != "form" or "hidden" in node.marks:
            continue
        n = links = 0
        below: set[bytes] = set()
        for x in node.children:
            if isinstance(x, str):
                n += len("".join(x.split()))
            elif (k := id(x)) in text:
                n += text.pop(k)
                links += link.pop(k)
                below |= inside.pop(k)
        if not n:
            continue  # what has no text has no shape
        if node.tag in BLOCKS and node.tag != "br":
            h = xxhash.xxh64(node.tag, seed=1)
            for m in sorted({_NUMBERS.sub("0", m) for m in node.marks}):
                h.update("\x01" + m)
            for b in sorted(below):
                h.update(b"\x02" + b)
            value = h.intdigest() - (1 << 63)
            below = {value.to_bytes(8, "little", signed=True)}
            out.append((node, value, n, n if node.tag == "a" else links))
        text[id(node)], link[id(node)], inside[id(node)] = n, n if node.tag == "a" else links, below
    return out


def subtrees(page: str) -> tuple[int, list[int], list[tuple[int, int, int]]]:
    """The hash of a page's main part; those of its subtrees that could be template: all but prose in an article, without its ancestors; and, where no article or main element
    tells the main part, (shape, letters, letters in links) of its containers."""
    tree = parse(page)
    mains = roots(tree)
    shapes: dict[int, list[int]] = {}
    if mains == [tree]:
        for node, value, n, links in _shapes(tree):
            if node.tag not in SHAPELESS:
                both = shapes.setdefault(value, [0, 0])
                both[0], both[1] = both[0] + n, both[1] + links
    all_ = _hashes(tree)
    of = {id(n): v for n, v in all_}
    identity = xxhash.xxh64_intdigest(b"".join(of[id(m)].to_bytes(8, "little", signed=True) for m in mains)) - (1 << 63)
    skip = {"#root", "html", "head", "body", "main", "article"} | (PROSE if mains != [tree] else frozenset({"b", "i", "br", "hr"}))
    return identity, sorted({v for n, v in all_ if n.tag not in skip}), [(v, *both) for v, both in sorted(shapes.items())]


def _letters(tree: Node) -> dict[int, int]:
    """The letters of text inside each element, none in elements that never hold main text."""
    n: dict[int, int] = {}
    for node in [*reversed([x for x, _ in _walk(tree)]), tree]:
        own = sum(len("".join(x.split())) if isinstance(x, str) else n.get(id(x), 0) for x in node.children)
        if own and not ((node.tag in DROPPED and node.tag not in ("form", "header")) or _says(node) == "reader"):
            n[id(node)] = own
    return n


def _repeated(article: Node) -> set[int]:
    """Articles within an article that stand beside others of their marks: what readers wrote."""
    out: set[int] = set()
    for x in [article, *(x for x, _ in _walk(article))]:
        kinds: dict[frozenset, list[Node]] = {}
        for y in x.children:
            if isinstance(y, Node) and y.tag == "article":
                kinds.setdefault(y.marks, []).append(y)
        out.update(id(y) for group in kinds.values() if len(group) > 1 for y in group)
    return out


def _headed(tree: Node) -> set[int]:
    """Elements that hold a heading."""
    out: set[int] = set()
    for x, holder in reversed(list(_walk(tree))):
        if x.tag in HEADINGS or id(x) in out:
            out.add(id(holder))
    return out


def main_text(page: str, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The main text of a page: character references decoded, white space inside a block one space, blocks joined by one space.

    Subtrees whose hash is in `template` are left out, prose inside an article excepted; where there is no article or main element, so are those whose shape is. Marked elements
    and forms go, but not if they hold an article or main element or, without either, most of the page's letters. Inside an article, marks on prose
    say nothing, and a header stays that holds a heading; articles of like marks beside each other are readers'."""
    tree = parse(page)
    mains = roots(tree)
    whole = mains == [tree]
    gone: set[int] = set()
    if template:
        kept = {"html", "body"} | (frozenset() if whole else PROSE)
        gone = {id(n) for n, v in _hashes(tree) if v in template and n.tag not in kept}
        if whole:
            gone.update(id(n) for n, v, *_ in _shapes(tree) if v in template and n.tag not in SHAPELESS)
    holders = set()
    for x, holder in reversed(list(_walk(tree))):
        if x.tag in ("article", "main", "body") or x.kind == "main" or id(x) in holders:
            if _says(x) != "reader":
                holders.add(id(holder))
    if whole:
        n = _letters(tree)
        holders.update(k for k, letters in n.items() if 2 * letters > n[id(tree)] and k not in gone)
    else:
        for m in mains:
            if m.tag == "article":
                gone |= _repeated(m)
    headed = set() if whole else _headed(tree)
    parts: list[str] = []
    todo: list[Node | str] = [x for m in reversed(mains) for x in (m, " ")]
    chosen = {id(m) for m in mains}
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(html.unescape(x) if "&" in x else x)
            continue
        if id(x) not in chosen and x.tag not in ("html", "body"):
            says = _says(x)
            if says == "furniture" and not whole and (x.tag in PROSE or (id(x) in headed and all(w in TITLES for m in x.marks if marked(m) for w in _PIECE.split(m)))):
                says = ""
            dropped = x.tag in DROPPED and x.tag != "form" and not (x.tag == "header" and id(x) in headed)
            if id(x) in gone or says == "reader" or "hidden" in x.marks or dropped or ((says or x.tag == "form") and id(x) not in holders):
                if x.tag in BLOCKS:
                    parts.append(" ")
                continue
        inside = reversed(x.children)
        if x.tag in BLOCKS:
            parts.append(" ")
            todo.append(" ")
        todo.extend(inside)
    return " ".join("".join(parts).split())


def _subtree_batches(batches):
    for b in pieces(batches, "html"):
        found = [subtrees(x or "") for x in b.column("html").to_pylist()]
        shapes = [[{"hash": v, "letters": n, "links": k} for v, n, k in x[2]] for x in found]
        kind = pa.list_(pa.struct([("hash", pa.int64()), ("letters", pa.int64()), ("links", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column("host"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.int64())), pa.array(shapes, kind)], ["host", "identity", "hashes", "shapes"])


def _text_batches(batches):
    for b in pieces(batches, "html"):
        texts, sets = [], {}
        for page, template in zip(b.column("html").to_pylist(), b.column("template").to_pylist(), strict=True):
            key = tuple(template or ())
            texts.append(main_text(page or "", sets.setdefault(key, frozenset(key))))
        chars = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), chars], ["page_id", "url", "text", "n_chars"])


def templates(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, linked: float = LINKED) -> DataFrame:
    """(host, template): the hashes of subtrees that stand on more than `ratio` of a host's different articles, and of the shapes that do and of whose letters, over all
    pages of the host, the share `linked` or more stands in links: menus and adverts, whose texts differ by page.

    Pages with equal main parts count once, so copies of an article don't make it a template. All counts combine before
    their shuffles; a host's template has at most (mean subtrees of a page / ratio) hashes of either kind.
    """
    found = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_subtree_batches, "host string, identity long, hashes array<long>, shapes array<struct<hash:long,letters:long,links:long>>")
    found = saved(found, "subtrees")
    totals = found.select("host", "identity").distinct().groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    exact = found.select("host", "identity", F.explode("hashes").alias("hash")).select("*", F.lit(0).cast("long").alias("letters"), F.lit(0).cast("long").alias("links"))
    shapes = found.select("host", "identity", F.explode("shapes").alias("s")).select("host", "identity", "s.*")
    each = exact.unionByName(shapes).groupBy("host", "hash", "identity").agg(F.max("letters").alias("letters"), F.max("links").alias("links"))
    counts = each.groupBy("host", "hash").agg(F.count("*").alias("n"), F.sum("letters").alias("letters"), F.sum("links").alias("links")).where("n > 1")
    common = counts.join(totals, "host").where((F.col("n") > F.col("pages") * ratio) & (F.col("links") >= F.col("letters") * linked))
    return common.groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("template"))


def extracted(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html).

    The article (else main, else body) less furniture by element, class, id or role, and less the host's template. Null html
    gives an empty text; null urls are one host; pages without markup are their own text; repeated rows stay; an empty table gives no
    rows; other columns are not read.
    """
    found = saved(templates(pages, ratio, least_pages), "templates")
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    rows = looked_up(rows, found, "host", ["page_id", "url"])
    return rows.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "template").mapInArrow(_text_batches, "page_id long, url string, text string, n_chars long")
