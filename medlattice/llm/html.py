"""HTML main text with site template removal.

Method: every page becomes a tree of elements; each block subtree is hashed
over its tags, attributes and text; Spark counts the pages of each host that
hold a hash, and subtrees found on `min_pages` pages of their host or more, and
on `min_share` of its pages at least, are deleted, inside articles (<article> or
<main>) too. There paragraphs, headings, lists' items, quotes, code and tables
need `prose_share` of the host's pages instead, since articles repeat words
legitimately; an article itself stays. Pages count by what their articles hold
(without an article, by the whole page), so that an article under many urls, or
repeated rows, count once.

What isn't main text but differs from page to page can't recur; as an addition
to the method, elements that are never main text by their tag, role or class
names (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, comments of readers) are dropped as well. In an article only whole names
of a short list count (INSIDE), ids only of boxes and sections, as headings give
their words to ids and classes there.

The main text is that of the articles if the page has one, else of what is left
of the body. Character references are decoded, white space inside a block
becomes one space, blocks are trimmed and joined by one newline.

The template table is broadcast only if it holds at most `max_broadcast` rows;
beyond that each page is joined with the templates among its own hashes.

Defined cases: null or empty html gives an empty text; unclosed, misnested and
cut-off markup is read as browsers do in the main; null urls share one host;
an empty table gives no rows;
columns of the input named like a result column give way to it.
"""

from __future__ import annotations

import hashlib
import html as _html
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medlattice.llm.common import quoted, read, slices, table
from medlattice.llm.urls import host_of

MIN_PAGES = 10
#: Of a host's distinct pages: what is on fewer isn't its template, however often it occurs on a large host.
MIN_SHARE = 0.01
#: For prose inside articles: passages that many articles share are text, only what nearly every page has is the site's.
PROSE_SHARE = 0.9
MAX_BROADCAST = 500_000
#: Elements of the HTML standard by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
DROP = frozenset("head script style noscript template iframe object svg canvas audio video nav footer aside form button select textarea input label menu dialog title noembed noframes map".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption article main hgroup".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt"}
#: Words of class and id names, and roles, of what isn't main text.
NAMES = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comments comment commentlist respond disqus newsletter subscribe subscription signup share sharing social related widget toolbar pagination pager".split())
INSIDE = frozenset("ad ads advert adverts advertisement sponsored sidebar navbar breadcrumb breadcrumbs comments comments-area commentlist respond disqus disqus_thread newsletter newsletter-signup share sharing share-buttons social-share related related-posts pagination pager".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert toolbar".split())
_OPEN = re.compile(r"<(?:(!--)|([!?])|(/)?([a-zA-Z][^\s/>]*))")
_STOP = re.compile("[>\"']")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_SPACE = re.compile(r"[\s]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []


#: What an element may close, and where the search for it ends; each is one slot of an open element.
_SLOTS = (
    (frozenset({"p"}), frozenset({"table", "td", "th", "article", "main", "section", "aside"})),
    (frozenset({"li"}), frozenset({"ul", "ol", "menu", "table"})),
    (frozenset({"dd", "dt"}), frozenset({"dl"})),
    (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    (frozenset({"tr"}), frozenset({"table"})),
    (frozenset({"head"}), frozenset()),
)
_CLOSES = {**{t: (0,) for t in CLOSES_P | {"p"}}, "li": (0, 1), "dd": (2,), "dt": (2,), "td": (3,), "th": (3,), "tr": (4,), "body": (0, 5)}


class _Open:
    """The stack of open elements. Each knows the nearest one above that each slot would close, and counts by name answer
    whether an end tag has anything to close, so that no tag is paid for by a walk that closes nothing."""

    def __init__(self, root: Node):
        self.nodes, self.near, self.scopes = [root], [(0,) * len(_SLOTS)], [{}]
        self.names: dict[str, int] = {}

    def push(self, node: Node) -> None:
        tag, at = node.tag, len(self.nodes)
        self.near.append(tuple(at if tag in names else 0 if tag in stop else up for (names, stop), up in zip(_SLOTS, self.near[-1])))
        self.nodes.append(node)
        self.names[tag] = self.names.get(tag, 0) + 1
        if tag in BLOCK:
            self.scopes.append({})
        else:
            self.scopes[-1][tag] = self.scopes[-1].get(tag, 0) + 1

    def pop_to(self, at: int) -> None:
        while len(self.nodes) > at:
            tag = self.nodes.pop().tag
            self.near.pop()
            self.names[tag] -= 1
            if tag in BLOCK:
                self.scopes.pop()
            else:
                self.scopes[-1][tag] -= 1

    def end(self, tag: str) -> None:
        if (self.names if tag in BLOCK else self.scopes[-1]).get(tag):  # an inline end tag doesn't close a block
            while self.nodes[-1].tag != tag:
                self.pop_to(len(self.nodes) - 1)
            self.pop_to(len(self.nodes) - 1)


def _tag_end(text: str, at: int) -> int:
    """The place of the > that ends a start tag; quotes without an end are ordinary characters."""
    while m := _STOP.search(text, at):
        if m[0] == ">":
            return m.start()
        close = text.find(m[0], m.end())
        at = close + 1 if close >= 0 else m.end()
    return len(text)


def parse(text: str) -> Node:
    """The tree of a page, in time that grows with its length; texts among children are decoded strings."""
    root = Node("#root")
    stack, at = _Open(root), 0

    def add_text(a: int, b: int) -> None:
        if b > a:
            raw = text[a:b]
            stack.nodes[-1].children.append(_html.unescape(raw) if "&" in raw else raw)

    def after(mark: str, start: int) -> int:
        found = text.find(mark, start)
        return found + len(mark) if found >= 0 else len(text)

    while m := _OPEN.search(text, at):
        add_text(at, m.start())
        comment, declared, end, tag = m.groups()
        if comment:
            at = after("-->", m.end())
            continue
        if declared or end:
            at = after(">", m.end())
            if end:
                stack.end(tag.lower())
            continue
        to = _tag_end(text, m.end())
        node = Node(tag.lower(), text[m.end() : to])
        at = to + 1
        for slot in _CLOSES.get(node.tag, ()):
            if k := stack.near[-1][slot]:
                stack.pop_to(k)
        stack.nodes[-1].children.append(node)
        if node.tag in RAW:
            found = re.compile(rf"</{re.escape(node.tag)}\b[^>]*>?", re.I).search(text, at)
            at = found.end() if found else len(text)
        elif node.tag not in VOID and not node.attrs.endswith("/"):
            stack.push(node)
    add_text(at, len(text))
    return root


def _is_noise(node: Node, in_article: bool) -> bool:
    if node.tag in DROP:
        return True
    if node.tag == "header":
        return not in_article  # the header of an article holds its headline
    if not node.attrs or node.tag in ("html", "body", "article", "main"):
        return False
    attrs: dict[str, str] = {}
    for m in _ATTR.finditer(node.attrs):
        attrs.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role") in ROLES:
        return True
    names, ids = attrs.get("class", "").split(), attrs.get("id", "").split()
    if in_article:
        return any(w in INSIDE for w in (names if node.tag in PROSE else names + ids))
    return any(w in NAMES or w.partition("-")[0] in NAMES or w.partition("_")[0] in NAMES for w in names + ids)


def subtree_hashes(root: Node) -> dict[int, int]:
    """id(node) -> 63-bit hash of a block subtree: tags, attributes and white-space-normalised text."""
    out: dict[int, int] = {}
    todo, done = [(root, False)], {}
    while todo:
        node, ready = todo.pop()
        if not ready:
            todo.append((node, True))
            todo.extend((c, False) for c in node.children if isinstance(c, Node))
            continue
        h = hashlib.blake2b(f"{node.tag}|{_SPACE.sub(' ', node.attrs).strip()}".encode("utf-8", "surrogatepass"), digest_size=8)
        for c in node.children:
            if isinstance(c, Node):
                h.update(b"\x01" + done.pop(id(c)))
            elif t := _SPACE.sub(" ", c).strip():
                h.update(b"\x02" + t.encode("utf-8", "surrogatepass"))
        done[id(node)] = h.digest()
        if node.tag in BLOCK and node.tag not in ("html", "body"):
            out[id(node)] = int.from_bytes(done[id(node)], "big") >> 1
    return out


def page_hashes(text: str | None) -> tuple[int, list[tuple[int, bool]]]:
    """What the page counts as, and (hash, is prose of an article) of its block subtrees, once each."""
    if not text:
        return 0, []
    root = parse(text)
    hashes, found = subtree_hashes(root), {}
    articles = _articles(root)
    inside, todo = set(), list(articles)
    while todo:
        node = todo.pop()
        inside.add(id(node))
        todo.extend(c for c in node.children if isinstance(c, Node))
    todo = [root]
    while todo:
        node = todo.pop()
        if (h := hashes.get(id(node))) is not None:
            found[h] = found.get(h, True) and id(node) in inside and node.tag in PROSE
        todo.extend(c for c in node.children if isinstance(c, Node))
    if articles:
        own = hashlib.blake2b(b"".join(hashes[id(a)].to_bytes(8, "big") for a in articles), digest_size=8)
    else:
        own = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8)
    return int.from_bytes(own.digest(), "big", signed=True), sorted(found.items())


def _articles(root: Node) -> list[Node]:
    """Outermost <article>/<main> elements outside of what is dropped."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag in ("article", "main"):
            out.append(node)
        elif node.tag == "#root" or not _is_noise(node, False):
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def main_text(text: str | None, templates=frozenset()) -> str:
    """The main text of a page; templates: hashes of its host's recurring subtrees."""
    if not text:
        return ""
    root = parse(text)
    hashes = subtree_hashes(root) if templates else {}
    articles = _articles(root)
    blocks: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if t := _SPACE.sub(" ", "".join(now)).strip():
            blocks.append(t)
        now.clear()

    inside = bool(articles)
    todo: list = [("node", a) for a in reversed(articles or [root])]
    while todo:
        kind, x = todo.pop()
        if kind == "flush":
            flush()
        elif kind == "text":
            now.append(x)
        else:
            if x.tag != "#root" and _is_noise(x, inside):
                continue
            if hashes.get(id(x)) in templates and x.tag not in ("article", "main"):
                continue
            if x.tag == "br":
                now.append(" ")
                continue
            if block := x.tag in BLOCK:
                flush()
                todo.append(("flush", None))
            if x.tag in VOID and not block:
                continue
            todo.extend(("node", c) if isinstance(c, Node) else ("text", c) for c in reversed(x.children))
    flush()
    return "\n".join(blocks)


def _hash_rows(batches):
    import pyarrow as pa

    for batch in slices(batches, column="html"):
        rows = [(h, k, *page_hashes(t)) for h, k, t in zip(batch.column("_host").to_pylist(), batch.column("_key").to_pylist(), batch.column("html").to_pylist())]
        flat = [(h, k, page, x, prose) for h, k, page, xs in rows for x, prose in [*xs, (None, None)]]  # the last one is the page itself
        cols = list(zip(*flat))
        kinds = zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in kinds], names=["_host", "_key", "page", "hash", "prose"])


def _extract(columns: list[str], known=None):
    def run(batches):
        import pyarrow as pa

        by_host = known.value if known else None
        for batch in slices(batches, column="html"):
            own = [by_host.get(h, frozenset()) for h in batch.column("_host").to_pylist()] if by_host is not None else [frozenset(x or ()) for x in batch.column("_templates").to_pylist()]
            texts = [main_text(t, s) for t, s in zip(batch.column("html").to_pylist(), own)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*columns, "text", "n_chars"])

    return run


def _placed(pages: DataFrame) -> DataFrame:
    return pages.withColumns({"_host": host_of(F.col("url")), "_key": F.xxhash64("url", "html")})


_HASHES = "_host string, _key bigint, page bigint, hash bigint, prose boolean"


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, prose_share: float = PROSE_SHARE) -> DataFrame:
    """_host, hash, pages: subtrees found on min_pages distinct pages of a host or more, and on min_share of them at least
    (prose_share, where only articles hold them, as prose)."""
    rows = _placed(pages.select("url", "html")).select("_host", "_key", "html").mapInArrow(_hash_rows, _HASHES)
    seen = rows.groupBy("_host", "hash", "page").agg(F.min("prose").alias("prose"))  # repeated pages once
    counted = seen.groupBy("_host", "hash").agg(F.count("*").alias("pages"), F.min("prose").alias("prose"))  # a null hash counts the host's pages
    counted = table(counted.filter(F.col("hash").isNull() | (F.col("pages") >= max(min_pages, 2))), "html-counts")
    hosts = counted.filter("hash is null").select("_host", F.col("pages").alias("of"))
    share = F.when(F.col("prose"), prose_share).otherwise(min_share)
    return counted.filter("hash is not null").join(hosts, "_host").filter(F.col("pages") >= share * F.col("of")).select("_host", "hash", "pages")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, max_broadcast: int = MAX_BROADCAST, min_share: float = MIN_SHARE, prose_share: float = PROSE_SHARE) -> DataFrame:
    """pages, without html, with text and n_chars."""
    spark = pages.sparkSession
    found = table(templates(pages, min_pages, min_share, prose_share), "html-templates")
    kept = [c for c in pages.columns if c.lower() not in ("text", "n_chars", "html", "_host", "_key", "_templates")]
    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    rows = _placed(pages.select(*[quoted(c) for c in kept], "html"))
    if found.limit(max_broadcast + 1).count() <= max_broadcast:
        by_host: dict[str, set[int]] = {}
        for r in found.select("_host", "hash").toLocalIterator():
            by_host.setdefault(r[0], set()).add(r[1])
        known = spark.sparkContext.broadcast({k: frozenset(v) for k, v in by_host.items()})
        return rows.mapInArrow(_extract(kept, known), schema)
    own = rows.select("_host", "_key", "html").mapInArrow(_hash_rows, _HASHES)
    own = own.join(found, ["_host", "hash"], "left_semi").groupBy("_key").agg(F.collect_set("hash").alias("_templates"))  # of one page
    return rows.join(own, "_key", "left").mapInArrow(_extract(kept), schema)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


QUERIES = {"op8_html_text": op8_html_text}
SQL: dict[str, str] = {}
