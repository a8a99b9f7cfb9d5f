"""HTML extraction (3): site template removal. Subtrees of elements are hashed and counted per host in Spark; subtrees that recur across
many pages of a host are deleted, and what is left of the article becomes text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimweave.llm.common import broadcast_if_small, materialise, table
from claimweave.session import ship

#: A subtree is part of a host's template if so many different pages of the host have it. The number does not grow with the host.
MIN_PAGES = 3

#: A quote opens a quoted value behind "=" only. The last form is for a tag that is cut off inside of a quoted value.
TAG = re.compile(r"<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
#: What isn't markup, and whether its content is text.
ASIDE = (("<!--", "-->", 2, False), ("<![CDATA[", "]]>", 9, True))
ATTR = re.compile(r"""([^\s=/"'>]++)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?""")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noframes", "xmp"}
CLOSE = {name: re.compile(rf"</{name}(?![^\s/>])", re.I) for name in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Never part of the main text. A header inside of an article is the article's own.
OUT = set("head nav header footer aside form script style noscript template button select textarea iframe noframes svg math canvas menu dialog object embed input option audio video title xmp".split())
CLUE = set("ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup sidebar sidebars widget widgets comment comments commentlist disqus respond replies reply menu menus navbar nav navigation breadcrumb breadcrumbs footer header masthead topbar share sharing social related recommended recommendations pagination pager skip login search".split())
HEADS = {"header", "masthead"}
#: Parts of a class name that say what kind of box it is, and those that say that something else has it, or that it isn't there.
BOX = set("area bar block body box container content form group holder inner item items link links list outer panel section slot unit wrap wrapper".split())
ABOUT = set("has no not with without is hide hides show shows enable enabled disable disabled open closed js on off".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar", "form"}
SHUTS_P = BLOCK - {"html", "body", "head", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: Running text.
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr ul ol dl table tbody figure figcaption".split())
#: What an opening tag ends, and the elements beyond which it doesn't look.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


@lru_cache(65536)
def clues(name: str) -> frozenset[str]:
    """What a class name or id says of its element: the name itself, or its last part that isn't only a kind of box, if that is a clue.
    Names such as has-sidebar or no-comments say nothing."""
    name = name.lower()
    parts = [x for x in re.split(r"[-_]+", name) if x]
    if set(parts) & ABOUT:
        return frozenset()
    while len(parts) > 1 and parts[-1] in BOX:
        parts.pop()
    return frozenset({name, *parts[-1:]} & CLUE)


class Node:
    __slots__ = ("kids", "out", "head", "tag", "key", "_hash")

    def __init__(self, tag: str, key: str = "", out: bool = False, head: bool = False) -> None:
        """out: by its name, class, id or role never main text. head: out only because it is a header, which inside of an article it may be."""
        self.tag, self.key, self.out, self.head, self.kids, self._hash = tag, key, out, head, [], None


class Open:
    """The open elements: where in the stack elements of each name are, and the blocks among them, so that no tag looks through the stack."""

    def __init__(self, root: Node) -> None:
        self.stack, self.named, self.blocks = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.named.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def last(self, *names: str) -> int:
        return max((self.named[n][-1] for n in names if self.named.get(n)), default=-1)

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            node = self.stack.pop()
            self.named[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()


def parse(source: str) -> Node:
    """The tree of a page: nodes and strings. End tags may be missing or stray. Takes time in proportion to the page."""
    root = Node("#root")
    opened = Open(root)
    stack, at, pos, last = opened.stack, 0, 0, source.rfind(">")

    def text(upto: int) -> None:
        if upto > at:
            stack[-1].kids.append(html.unescape(source[at:upto]))

    while (lt := source.find("<", pos)) >= 0:
        if aside := next((x for x in ASIDE if source.startswith(x[0], lt)), None):
            text(lt)
            shut = source.find(aside[1], lt + aside[2])
            if aside[3]:
                stack[-1].kids.append(source[lt + aside[2] : shut if shut >= 0 else len(source)])
            pos = at = shut + 3 if shut >= 0 else len(source)
            continue
        m = TAG.match(source, lt) if lt < last else None
        if not m:
            if lt > last:
                break
            pos = lt + 1
            continue
        text(lt)
        pos = at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        if m[1] or m[4]:
            if name == "br":
                stack[-1].kids.append(" ")
            i = opened.last(name)
            if i > 0 and (name in BLOCK or i > opened.blocks[-1]):  # an inline end tag doesn't end a block
                opened.cut(i)
            continue
        attrs = m[3] or m[6] or ""
        given = {k.lower(): v.strip("\"'") for k, v in ATTR.findall(attrs)} if attrs.strip(" /") else {}
        own = name not in ("html", "body", "main")
        said = frozenset().union(*map(clues, f"{given.get('class', '')} {given.get('id', '')}".split())) if own and given else frozenset()
        sure = name in OUT - HEADS or bool(said - HEADS) or own and given.get("role", "").lower() in ROLES or "hidden" in given or given.get("aria-hidden") == "true"
        head = not sure and (name in HEADS or bool(said))
        node = Node(name, f"{name}.{given.get('class', '')}#{given.get('id', '')}", sure or head, head)
        if name in SHUTS_P and stack[opened.blocks[-1]].tag == "p":
            opened.cut(opened.blocks[-1])
        ends, upto = IMPLIED.get(name, ((), ()))
        if ends and (inside := [i for n in ends if (i := opened.last(n)) > opened.last(*upto)]):
            opened.cut(min(inside))
        stack[-1].kids.append(node)
        if name in RAW:
            close = CLOSE[name].search(source, pos)
            end = close.start() if close else len(source)
            if name in ("textarea", "title"):
                node.kids.append(html.unescape(source[pos:end]))
            shut = source.find(">", end)
            pos = at = len(source) if shut < 0 else shut + 1
        elif name not in VOID and not attrs.rstrip().endswith("/") or name in BLOCK and name not in VOID:
            opened.push(node)
    text(len(source))
    return root


def walk(root: Node) -> Iterator[tuple[Node, Node]]:
    """Parents and nodes, parents first."""
    todo = [root]
    while todo:
        n = todo.pop()
        for k in n.kids:
            if isinstance(k, Node):
                yield n, k
                todo.append(k)


def hashes(root: Node) -> None:
    """Sets each node's hash: of its name, class and id, and of what it holds, white space aside."""
    for n in reversed([root, *(k for _, k in walk(root))]):
        h = blake2b(n.key.encode("utf-8", "surrogatepass"), digest_size=8)
        for k in n.kids:
            h.update(k._hash if isinstance(k, Node) else " ".join(k.split()).encode("utf-8", "surrogatepass"))
            h.update(b"\0")
        n._hash = h.digest()


def signed(b: bytes) -> int:
    return int.from_bytes(b, "big", signed=True)


def holders(root: Node) -> set[int]:
    """The elements that are or hold an article or a main."""
    holds: set[int] = set()
    for parent, n in reversed(list(walk(root))):
        if n.tag in ("article", "main") or id(n) in holds:
            holds |= {id(n), id(parent)}
    return holds


def removable(root: Node) -> list[Node]:
    """The elements that may be a site's template: blocks outside the article, and within it containers only, never its running text; never
    one that is or holds an article or a main."""
    holds = holders(root)
    out, todo = [], [(root, False)]
    while todo:
        n, inside = todo.pop()
        inside = inside or n.tag in ("article", "main")
        for k in n.kids:
            if isinstance(k, Node):
                todo.append((k, inside))
                if k.kids and k.tag in BLOCK and k.tag not in ("html", "body") and id(k) not in holds and not (inside and k.tag in TEXTUAL):
                    out.append(k)
    return out


def template_of(root: Node, template: set[int]) -> set[int]:
    """Ids of the largest subtrees of a hashed page that are template."""
    found = {id(n) for n in removable(root) if signed(n._hash) in template}
    top, todo = set(), [root]
    while todo:
        n = todo.pop()
        if id(n) in found:
            top.add(id(n))
        else:
            todo.extend(k for k in n.kids if isinstance(k, Node))
    return top


def _tops(root: Node, tag: str, gone: set[int], all_of_them: bool) -> list[Node]:
    """Elements named tag, in page order, none within another; without all_of_them, those that aren't inside of what is left out."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.tag == tag:
            out.append(n)
            continue
        todo.extend(k for k in reversed(n.kids) if isinstance(k, Node) and (all_of_them or not k.out and id(k) not in gone))
    return out


def _spared(root: Node, gone: set[int]) -> set[int]:
    """On a page without article and main, forms that hold over half of the text: pages of some frameworks are one form."""
    size: dict[int, int] = {}
    nodes = [root, *(k for _, k in walk(root))]
    for n in reversed(nodes):
        own = 0 if id(n) in gone or n.out and n.tag != "form" else sum(size[id(k)] if isinstance(k, Node) else len("".join(k.split())) for k in n.kids)
        size[id(n)] = own
    return {id(n) for n in nodes if n.tag == "form" and 2 * size[id(n)] > size[id(root)]}


def blocks(root: Node, gone: set[int] = frozenset()) -> list[str]:
    """The text blocks of the main part, in page order, without the subtrees in gone.

    The main part is the page's articles, or else its mains, or else all of it. Articles inside of what is left out (cards in a sidebar, comments) count only on a page that has no other: what a
    wrapper is called doesn't lose the article.
    """
    spared: set[int] = set()
    tops = _tops(root, "article", gone, False) or _tops(root, "main", gone, False) or _tops(root, "article", gone, True) or _tops(root, "main", gone, True)
    if not tops:
        tops, spared = [root], _spared(root, gone)
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if line := " ".join("".join(run).split()):
            out.append(line)
        run.clear()

    for top in tops:
        flush()
        article = top is not root
        todo = [top]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                run.append(n)
            elif n is None:
                flush()
            elif n.tag == "br":
                run.append(" ")
            elif n is top or id(n) not in gone and (not n.out or article and n.head or id(n) in spared):
                if n.tag in BLOCK:
                    flush()
                    todo.append(None)
                todo.extend(reversed(n.kids))
        flush()
    return out


def extract(source: str | None, template: set[int] = frozenset()) -> str:
    return extracted(source, template)[0]


def extracted(source: str | None, template: set[int] = frozenset()) -> tuple[str, int]:
    """The main text, and how many subtrees were deleted as the site's template."""
    if not source:
        return "", 0
    root = parse(source)
    gone: set[int] = set()
    if template:
        hashes(root)
        gone = template_of(root, template)
    return "\n".join(blocks(root, gone)), len(gone)


def host_of(url: str = "url") -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def page_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page, template array<long>): by a hash of host and source, those subtrees of the page that MIN_PAGES different pages of its host have.

    Pages of the same source are one, so that mirrored pages don't make a template of their text. An array has no more than the page's
    subtrees. Subtrees of a hot host are combined before they are shuffled, and known ones are joined, not collected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, hosts, found, bodies = [], [], [], []
            for key, host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                root = parse(source.as_py())
                hashes(root)
                own = {signed(n._hash) for n in removable(root)}
                keys += [key] * len(own)
                hosts += [host] * len(own)
                bodies += [signed(root._hash)] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hosts, pa.string()), pa.array(bodies, pa.int64()), pa.array(found, pa.int64())], ["page", "host", "body", "h"])

    ship(pages.sparkSession)
    rows = pages.where(F.char_length(html_col) > 0).select(page_key(url_col, html_col).alias("page"), host_of(url_col).alias("host"), F.col(html_col).alias("html"))
    seen = materialise(rows.mapInArrow(run, "page long, host string, body long, h long"), "subtrees")
    often = seen.groupBy("host", "h", "body").agg(F.lit(1).alias("one")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_PAGES)
    often = broadcast_if_small(materialise(often.select("host", "h"), "often"))
    return seen.join(often, ["host", "h"]).groupBy("page").agg(F.collect_set("h").alias("template"))


def page_key(url_col: str, html_col: str) -> Column:
    return F.xxhash64(host_of(url_col), F.col(html_col))


def extract_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with main_text and n_template, the number of subtrees that were deleted as the site's template. A null or empty page has an
    empty text; pages without a host form a host of their own. Repeated rows stay; columns of those two names are replaced."""
    pages = pages.drop("main_text", "n_template")
    names, at = pages.columns, pages.columns.index(html_col)
    known = materialise(page_templates(pages, url_col, html_col), "templates").withColumnsRenamed({"page": "__page", "template": "__template"})
    joined = pages.withColumn("__own", page_key(url_col, html_col))
    known = broadcast_if_small(known)
    joined = joined.join(known, joined["__own"] == known["__page"], "left").select(*names, "__template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [extracted(source.as_py(), set(t.as_py() or ())) for source, t in zip(b.column(at), b.column(len(names)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([t for t, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())], [*names, "main_text", "n_template"])

    return joined.mapInArrow(run, StructType([*pages.schema.fields]).add("main_text", "string").add("n_template", "long"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"), "n_template")
