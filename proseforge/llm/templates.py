"""Main text of web pages after removing the templates of their sites.

Every element of a page is hashed with all that it holds.  Spark counts under how many different
titles a hash occurs at its host, so that copies of one page count once.  An element that recurs
under many titles is part of the site's template and is deleted with its subtree, as is anything
whose tag says that it is a menu, a form, a script and the like.  What is left of the
article is put out block by block.  Classes such as "sidebar" delete nothing: a wrapper around the
whole article may carry them.  Only what readers reply to an article, marked as such within it, goes
with its class.

The paragraphs of an article may recur on a site and still be its text.  Within an article only boxes
are therefore deleted, and only if they recur on a good part of the host.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseforge.llm.common import map_texts, quoted
from proseforge.session import cut_lineage

#: Titles, and share of the host's titles, under which an element recurs, outside articles and within.
OUTSIDE, WITHIN = (4, 0.01), (10, 0.3)
#: Most template elements that are broadcast; more of them are joined to the pages.
BROADCAST_ELEMENTS = 2_000_000

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
NO_TEXT = frozenset(
    "head script style noscript template title nav header footer aside form button select textarea input svg math iframe "
    "object canvas audio video dialog menu xmp noembed noframes".split()
)
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr figcaption caption".split())
#: Starting one of the first closes an open one of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("article main section div ul ol dl table body html td th blockquote".split())
#: A class, id or role that says that what an element within an article holds are the words of its readers.
REPLIES = re.compile(r"(?i)(?:^|\s)(?:comments?|disqus|respond|replies)(?:$|\s)")
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


@dataclass
class Open:
    """An element that is still open: its hash so far, and where its blocks begin.

    ``hidden`` tells that its blocks are not put out, by the class (1) or by the tag (2) of it or of an
    element around it.
    """

    tag: str
    hidden: int
    article: bool
    digest: object
    texts: int = 0
    first_block: int = 0


@dataclass
class Page:
    """Blocks of a page as (text, within an article), and its elements as (hash, within an article)."""

    blocks: list[tuple[str, bool]] = field(default_factory=list)
    elements: list[tuple[bytes, bool]] = field(default_factory=list)
    title: str = ""


def parse(page: str, is_template: Callable[[bytes, bool], bool] = lambda digest, within: False) -> Page:
    """Blocks and elements of a page; elements that ``is_template`` names are deleted with all they hold."""
    out = Page()
    root = Open("", 0, False, blake2b(digest_size=8))
    stack = [root]
    texts: list[str] = []

    def flush() -> None:
        """Close the block that is being gathered."""
        if texts:
            block = " ".join(entities.unescape("".join(texts)).split())
            texts.clear()
            if block and not stack[-1].hidden:
                out.blocks.append((block, stack[-1].article))

    def close() -> None:
        element = stack[-1]
        inline = element.tag in INLINE
        if not inline:
            flush()
        stack.pop()
        digest = element.digest.digest()
        stack[-1].digest.update(b"<" + digest)
        stack[-1].texts += element.texts
        if inline or not element.texts or element.tag in ("html", "body", "article", "main"):
            return
        within = stack[-1].article
        if within and element.tag in PARAGRAPHS:
            return
        out.elements.append((digest, within))
        if is_template(digest, within):
            del out.blocks[element.first_block :]

    def text(value: str) -> None:
        if value:
            texts.append(value)
            bare = value.split()
            if bare:
                stack[-1].digest.update(" ".join(bare).encode("utf-8", "replace"))
                stack[-1].texts += 1

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag, ends = name.lower(), bool(m[1] or m[4])
        if ends:
            place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if place and not (tag in INLINE and any(e.tag not in INLINE for e in stack[place + 1 :])):
                while len(stack) > place:
                    close()
            elif tag == "p":
                flush()
            continue
        if tag == "br":
            texts.append(" ")
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        if tag not in INLINE:
            flush()
            ends_here = CLOSES.get(tag, set()) | {"p"}
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends_here:
                    while len(stack) > i:
                        close()
                    break
                if stack[i].tag in SCOPE and stack[i].tag not in ends_here:
                    break
        attributes = m[3] if m[2] else m[6]
        said = [a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(attributes)] if attributes else []
        article = stack[-1].article or tag in ("article", "main")
        hidden = 2 if tag in NO_TEXT else stack[-1].hidden
        if hidden < 2 and tag in ("article", "main"):
            hidden = 0
        elif not hidden and stack[-1].article and any(REPLIES.search(v) for v in said):
            hidden = 1
        element = Open(tag, hidden, article, blake2b("\0".join([tag, *said]).encode("utf-8", "replace"), digest_size=8), 0, len(out.blocks))
        stack.append(element)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
            inside = page[at : end.start() if end else len(page)]
            if tag == "title" and not out.title:
                out.title = " ".join(entities.unescape(inside).split())
            at = end.start() if end else len(page)
            if end is None:
                break
    while len(stack) > 1:
        close()
    flush()
    return out


def main_text(page: str | None, is_template: Callable[[bytes, bool], bool] = lambda digest, within: False) -> str:
    """Blocks of the article, or of all the page if it marks none, one per line."""
    if not page:
        return ""
    blocks = parse(page, is_template).blocks
    articles = [b for b, within in blocks if within]
    return "\n".join(articles or [b for b, _ in blocks])


HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)")


def host_of(url: str | None) -> str:
    """The host of an address in lower case; empty if there is none."""
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def key_of(host: bytes, digest: bytes, within: bool) -> int:
    """A 64-bit number for an element at a host."""
    made = blake2b(digest + host + (b"+" if within else b"-"), digest_size=8).digest()
    return int.from_bytes(made, "little", signed=True)


def _digest(url: str, html: str) -> Column:
    """What tells two pages apart."""
    return F.md5(F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (url, html)]))


def subtrees(df: DataFrame, url: str, html: str) -> DataFrame:
    """(page, host, title, keys): the distinct elements of every page; ``page`` is a digest of address and html."""
    element = T.StructType([T.StructField("key", T.LongType()), T.StructField("within", T.BooleanType())])
    added = T.StructType([T.StructField("host", T.StringType()), T.StructField("title", T.BinaryType()), T.StructField("keys", T.ArrayType(element))])

    def work(pages: list[str | None], urls: list[str | None]) -> dict[str, list]:
        made: dict[str, list] = {"host": [], "title": [], "keys": []}
        for page, address in zip(pages, urls):
            host = host_of(address)
            found = parse(page) if page else Page()
            # The first block of the article stands for the title where it says more.
            first = next((b for b, within in found.blocks if within), "")
            made["host"].append(host)
            made["title"].append(blake2b(f"{found.title}\0{first}".encode("utf-8", "replace"), digest_size=8).digest())
            keys = {(key_of(host.encode(), d, w), w) for d, w in found.elements}
            made["keys"].append([{"key": k, "within": w} for k, w in sorted(keys)])
        return made

    rows = df.select(F.col(quoted(url)).cast("string").alias("url"), F.col(quoted(html)).cast("string").alias("html"))
    rows = rows.withColumn("page", _digest("url", "html"))
    return map_texts(rows, "html", ["page"], added, work, ["url"])


def template_keys(found: DataFrame) -> DataFrame:
    """(key): elements that recur under enough titles of their host."""
    titles = found.groupBy("host", "title").agg(F.lit(1)).groupBy("host").agg(F.count(F.lit(1)).alias("titles"))
    seen = found.select("host", "title", F.inline("keys")).groupBy("host", "key", "within", "title").agg(F.lit(1))
    counts = seen.groupBy("host", "key", "within").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min(OUTSIDE[0], WITHIN[0]))
    least = lambda rule: (F.col("n") >= rule[0]) & (F.col("n") >= rule[1] * F.col("titles"))
    return counts.join(titles, "host").filter(F.when(F.col("within"), least(WITHIN)).otherwise(least(OUTSIDE))).select("key").distinct()


def extract(df: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Add ``text``, the main text of every page without the templates of its host.

    Blocks are in page order, joined by line feeds; white space within a block is one space.  A null or
    empty page has an empty text.  Pages without an address share one host.  Pages that repeat count
    once and are returned each.  A column called ``text`` is replaced; all others are kept (``keep``
    names fewer).
    """
    keep = df.columns if keep is None else keep
    keys = cut_lineage(template_keys(subtrees(df, url, html)), "templates")
    added = T.StructType([T.StructField("text", T.StringType())])
    if keys.count() <= BROADCAST_ELEMENTS:
        # Eight bytes for each; the count has been checked.
        found = np.sort(np.array([r.key for r in keys.collect()], np.int64))
        shipped = df.sparkSession.sparkContext.broadcast(found)

        def work(pages: list[str | None], urls: list[str | None]) -> dict[str, list]:
            known = shipped.value

            def has(key: int) -> bool:
                i = int(known.searchsorted(key))
                return i < len(known) and known[i] == key

            return {"text": [_without(p, u, has) for p, u in zip(pages, urls)]}

        return map_texts(df, html, keep, added, work, [url])

    rows = subtrees(df, url, html).select("page", F.explode("keys.key").alias("key")).join(keys, "key", "left_semi")
    rows = rows.groupBy("page").agg(F.collect_set("key").alias("_keys"))
    names = [f"c{i}" for i in range(len(df.columns))]
    at = dict(zip(df.columns, names))
    wide = df.toDF(*names).withColumn("page", _digest(at[url], at[html])).join(rows, "page", "left")

    def deleted(pages: list[str | None], urls: list[str | None], own: list[list[int] | None]) -> dict[str, list]:
        return {"text": [_without(p, u, set(k or ()).__contains__) for p, u, k in zip(pages, urls, own)]}

    out = map_texts(wide, at[html], [at[c] for c in keep if c != "text"], added, deleted, [at[url], "_keys"])
    return out.toDF(*[c for c in keep if c != "text"], "text")


def _without(page: str | None, url: str | None, has: Callable[[int], bool]) -> str:
    host = host_of(url).encode()
    return main_text(page, lambda digest, within: has(key_of(host, digest, within)))
