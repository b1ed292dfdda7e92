"""Main text of web pages: rules for parts that are never an article, and removal of site templates.

Each page is parsed into elements.  Parts that their tag, role, class or id names as menu, header, footer, sidebar,
notice, advert, form or comments go.  Of what is left, every element subtree with text gets a hash; Spark counts the
hashes per host, and subtrees that recur in `least_pages` different contents of their host are deleted, whatever the
size of the host.

A content is the nearest <article> or <main> around the subtree, else the page; equal ones count once, so that copies
of a page or of an article make no template.  Articles, main parts and what holds them are not counted; in them only
blocks are, and no rows of tables or items of lists, which recur by chance.  A content that would lose all its text
keeps it.  Where a page has articles, its text is theirs; else that of <main>; else all.

Hashes are counted and joined by host and hash, rows and not lists, so that a host with a third of all pages is
spread by its hashes.  A page gets back its own hashes only.

Results by case: null and empty pages give an empty text; unclosed and stray tags are closed or ignored as browsers
do; repeated rows count as one page; a null url has a host of its own; an empty table gives an empty result.
"""

import hashlib
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches
from .kernels import slices

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<(?=[/!?a-zA-Z])[^>]*+\Z""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
SPACED = frozenset("br td th option img wbr".split()) - {"wbr"}
NEVER = frozenset("head script style textarea title iframe noembed noframes noscript template svg math canvas object audio video map nav footer aside form button select datalist input label fieldset dialog menu xmp".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog alert form menu menubar toolbar".split())
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert newsletter "
    "subscribe subscription signup sidebar sidenav menu navbar nav navigation breadcrumb breadcrumbs footer masthead topbar comment comments commentlist disqus respond "
    "replies related recommended recommendations share sharing social popup modal overlay toolbar pagination pager login paywall skip".split()
)
PIECES = frozenset("caption dd dt legend li tbody tfoot thead tr".split())
HEADER = frozenset(("header", "site-header", "page-header"))
CLOSES = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}


class Element:
    __slots__ = ("tag", "parts", "gone", "mark", "main", "held", "digest", "size", "around", "cut")

    def __init__(self, tag, gone):
        self.tag, self.parts, self.gone, self.mark, self.main, self.held = tag, [], gone, None, tag in ("article", "main"), False
        self.digest, self.size, self.around, self.cut = None, 0, None, False


def named_away(tag, attributes):
    """Whether tag, role, class or id say that this is no article text."""
    if tag in NEVER:
        return True
    if not attributes.strip():
        return False
    got = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", ""):
        return True
    if tag in ("html", "body", "main"):
        return False
    if got.get("role") in ROLES:
        return True
    names = f"{got.get('class', '')} {got.get('id', '')}".split()
    if any(n in HEADER for n in names):
        return True
    return any(n in PARTS or PARTS.intersection(re.split("[-_]+", n)[:1] + re.split("[-_]+", n)[-1:]) for n in names)


def parse(page):
    """The page's root element."""
    root = Element("#", False)
    stack, at = [root], 0

    def close(tags, walls):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in walls:
                return

    while at < len(page):
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            stack[-1].parts.append(text)
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if m[0].startswith("<![CDATA["):
                stack[-1].parts.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if any(e.tag == tag for e in stack):
                close((tag,), ())
            continue
        attributes = m[3] or m[6] or ""
        if tag in CLOSES:
            close(CLOSES[tag][0].split(), CLOSES[tag][1])
        if tag in BLOCK:
            close(("p",), ("article", "main", "section", "div", "td", "th", "li", "button", "object", "blockquote", "body"))
        new = Element(tag, named_away(tag, attributes) or tag == "header" and not any(e.main for e in stack))
        stack[-1].parts.append(new)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            stack.append(new)
        elif tag not in VOID and tag in BLOCK:
            stack.append(new)  # a slash means nothing on these
    return root


def postorder(root):
    """Elements that are left, children first, each with whether it stands inside an article."""
    out, todo = [], [(root, False)]
    while todo:
        e, inside = todo.pop()
        if not e.gone:
            out.append((e, inside))
            todo += [(x, inside or e.main) for x in e.parts if isinstance(x, Element)]
    return reversed(out)


def flat(text):
    return " ".join(html.unescape(text).split())


def mark_subtrees(root):
    """(subtree, content) hashes of the subtrees with text that hold no article."""
    order, marks = list(postorder(root)), set()
    for e, _ in order:
        e.held = e.main or any(x.held for x in e.parts if isinstance(x, Element) and not x.gone)
        digest, worded = hashlib.blake2b(e.tag.encode(), digest_size=8), False
        for x in e.parts:
            if isinstance(x, str):
                text = flat(x)
                worded |= bool(text)
                e.size += len(text)
                digest.update(b"\0" + text.encode("utf-8", "replace"))
            elif not x.gone and x.digest is not None:
                worded = True
                e.size += x.size
                digest.update(b"\1" + x.digest.to_bytes(8, "big", signed=True))
        if worded:
            e.digest = int.from_bytes(digest.digest(), "big", signed=True)
    for e, inside in reversed(order):
        around = e if e.main or e.tag == "#" else e.around
        for x in e.parts:
            if isinstance(x, Element):
                x.around = around
        if e.digest is not None and not e.held and e.tag != "#" and (not inside or e.tag in BLOCK and e.tag not in PIECES):
            e.mark = e.digest
            marks.add((e.mark, around.digest))
    return marks


def cut_templates(root, templates):
    """Cuts the subtrees among templates, but for contents of which no text would be left."""
    todo, cuts = [root], {}
    while todo:
        e = todo.pop()
        if e.gone:
            continue
        if e.mark is not None and e.mark in templates:
            cuts.setdefault(e.around, []).append(e)
        else:
            todo += [x for x in e.parts if isinstance(x, Element)]
    for around, cut in cuts.items():
        if sum(e.size for e in cut) < around.size:
            for e in cut:
                e.cut = True


def block_texts(roots):
    """Texts of the blocks, in page order."""
    out, held = [], []

    def flush():
        text = flat("".join(held))
        held.clear()
        if text:
            out.append(text)

    todo = list(reversed(roots))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            held.append(x)
        elif x is None:
            flush()
        elif not x.gone and not x.cut:
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            elif x.tag in SPACED:
                held.append(" ")
                todo.append(" ")
            todo += reversed(x.parts)
    flush()
    return out


def main_text(root):
    """Text of the outermost articles, else of the main parts, else of all."""
    found = {"article": [], "main": []}
    todo = [root]
    while todo:
        e = todo.pop()
        if e.gone:
            continue
        if e.main:
            found[e.tag].append(e)
        if e.tag != "article":
            todo += [x for x in reversed(e.parts) if isinstance(x, Element)]
    for roots in (found["article"], [m for m in found["main"]], [root]):
        if roots and (texts := block_texts(roots)):
            return "\n".join(texts)
    return ""


def extract_page(page, templates=frozenset()):
    root = parse(page or "")
    if templates:
        mark_subtrees(root)
        cut_templates(root, templates)
    return main_text(root)


def list_subtrees(batches):
    for batch in batches:
        for part in slices(batch, "html"):
            marks = [sorted(mark_subtrees(parse(x or ""))) for x in part.column("html").to_pylist()]
            of = pa.array([i for i, m in enumerate(marks) for _ in m], pa.int64())
            subtrees, contents = (pa.array([x[k] for m in marks for x in m], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_pydict({"mark": part.column("mark").take(of), "host": part.column("host").take(of), "subtree": subtrees, "content": contents})


def extract(batches):
    for batch in batches:
        for part in slices(batch, "html"):
            texts = [extract_page(x, frozenset(t or ())) for x, t in zip(part.column("html").to_pylist(), part.column("templates").to_pylist())]
            yield pa.RecordBatch.from_pydict({"key": part.column("key"), "url": part.column("url"), "text": pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string())})


def extract_text(pages: DataFrame, least_pages=5, key="page_id", url="url", page="html") -> DataFrame:
    """(key, url, text) for each row of pages.

    A subtree is a template where it recurs in `least_pages` different contents of its host.
    """
    arrow_batches(pages.sparkSession)
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    rows = rows.withColumn("mark", F.xxhash64("key", "url", "html"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))
    each = rows.withColumn("host", host).select("mark", "host", "html").mapInArrow(list_subtrees, "mark long, host string, subtree long, content long")
    counts = each.select("host", "subtree", "content").distinct().groupBy("host", "subtree").count()
    templates = counts.where(F.col("count") >= least_pages).select("host", "subtree")
    told = each.join(templates, ["host", "subtree"], "left_semi").groupBy("mark").agg(F.collect_set("subtree").alias("templates"))
    kind = dict(rows.dtypes)["key"]
    out = rows.join(told, "mark", "left").select("key", "url", "html", "templates").mapInArrow(extract, f"key {kind}, url string, text string")
    return out.withColumnRenamed("key", key).withColumnRenamed("url", url)


def op9_html_extraction(spark, sf_dir):
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
