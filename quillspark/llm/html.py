"""Main text of HTML pages: suffix arrays over the pages of a host find repeated boilerplate; page structure confirms it.

Pages are cut into blocks with a role from their containers: part of an article, part of a main region, known chrome
(menus, headers, footers, sidebars, notices, adverts, forms, comments) or open. For each host the token streams of all
text outside articles are laid end to end; a suffix array, built by prefix doubling as far as runs of MIN_RUN tokens,
brings equal runs together; runs on several distinct pages cover boilerplate. Every page goes this way, and what runs
cover goes. Then the check: chrome goes even where no run covers it, and an article's own text always stays, however often
it is copied, so it is no part of the streams: a page that holds the text of another's article outside one keeps it.

A host's pages are dealt to shards by page, as many as its pages and bytes ask for, so that no task holds a whole host.
Each shard tells its runs, as digests with the smallest and largest page that has them, and an aggregate over the host
finds those on two distinct pages of any shards; they go back to the shards whose open blocks have them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape
from itertools import groupby
from zlib import compress, decompress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import bounded_batches, few, read_table
from quillspark.llm.urls import host_of

#: Tokens of a run, block ends included; it must be on two distinct pages of the host.
MIN_RUN = 6
#: Pages and bytes of a shard, about.
SHARD_PAGES, SHARD_BYTES = 96, 8 << 20
#: Roles of blocks.
CHROME, OPEN, MAIN, ARTICLE = 0, 1, 2, 3

#: Elements whose text is never shown as text, elements that end a block, elements that hold others.
HIDDEN = {"script", "style", "template", "noscript", "iframe", "object", "svg", "math", "canvas", "audio", "video", "head", "title", "select", "textarea", "datalist", "noframes"}
RAW = {"script", "style", "textarea", "title", "iframe", "noframes"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table",
    "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
NESTED = {
    "article", "aside", "blockquote", "body", "details", "dialog", "div", "dl", "fieldset", "figure", "footer", "form", "header", "html", "main", "menu", "nav", "ol", "search", "section",
    "table", "tbody", "td", "th", "tr", "ul", "button", "label", "span", "li", "p",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Containers and names of containers that hold no article text; the second list holds outside articles only.
CHROME_TAGS = {"nav", "aside", "form", "menu", "dialog", "button", "search", "fieldset"}
PAGE_CHROME_TAGS = {"header", "footer"}
CHROME_ROLES = {"navigation", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "banner", "contentinfo"}
CHROME_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "newsletter", "subscribe", "subscription", "signup", "login", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "widget", "widgets", "share", "sharing", "social", "related",
    "recommended", "comment", "comments", "commentlist", "reply", "replies", "disqus", "popup", "modal", "toolbar", "pagination", "pager", "search", "skip", "alert",
}
#: Words that say nothing beside a name of chrome ("share-buttons", "related-posts").
PLAIN_NAMES = {
    "area", "article", "articles", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "col", "column", "container", "content", "count", "form", "group", "icon", "icons", "inner",
    "item", "items", "left", "link", "links", "list", "main", "message", "module", "outer", "page", "panel", "post", "posts", "right", "row", "section", "site", "slot", "story", "stories", "text",
    "title", "top", "unit", "wrap", "wrapper",
}
PAGE_CHROME_NAMES = {"header", "footer", "masthead", "topbar", "copyright"}
ARTICLE_NAMES = {"articlebody", "post-content", "entry-content", "article-body", "article-content", "post-body", "story-body"}

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?<![\w-])(hidden)(?![\w-])""")
NAME = re.compile(r"[\s_]+|(?<=[a-z])-(?=[a-z])|-+|(?<=[a-z])(?=[A-Z])")


def role_of(tag: str, attributes: str, inside: int) -> int:
    """The role of an element's text, given that of its surroundings: chrome stays chrome, articles stay articles but for chrome in them.

    A name of chrome among others ("social-science", "related-work") proves nothing: its text is open, for runs to decide, in articles too.
    """
    if inside == CHROME or tag in CHROME_TAGS or (tag in PAGE_CHROME_TAGS and inside < MAIN):
        return CHROME
    role, suspect = inside, False
    if attributes and ("=" in attributes or "hidden" in attributes):
        for name, a, b, c, gone in ATTRIBUTE.findall(attributes):
            value, name = a or b or c, name.lower()
            if gone or (name == "aria-hidden" and value == "true"):
                return CHROME
            if name == "role":
                if value.lower() in CHROME_ROLES:
                    return CHROME
                role = max(role, {"main": MAIN, "article": ARTICLE}.get(value.lower(), role))
            elif name in ("class", "id"):
                for one in value.split():
                    words = {w.lower() for w in NAME.split(one)} - {""}
                    named = words & CHROME_NAMES or (inside < MAIN and words & PAGE_CHROME_NAMES)
                    if named and all(w in CHROME_NAMES or w in PAGE_CHROME_NAMES or w in PLAIN_NAMES or w.isdigit() for w in words):
                        return CHROME
                    suspect |= bool(named)
                if set(value.lower().split()) & ARTICLE_NAMES:
                    role = ARTICLE
            elif name == "itemprop" and value.lower() == "articlebody":
                role = ARTICLE
    return OPEN if suspect else max(role, {"article": ARTICLE, "main": MAIN}.get(tag, role))


def blocks(html: str) -> list[tuple[int, str]]:
    """(role, text) of a page's blocks in page order, with character references decoded and one blank for white space."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    role, at, end = OPEN, 0, len(html)

    def close() -> None:
        text = "".join(parts)
        parts.clear()
        text = " ".join((unescape(text) if "&" in text else text).split())
        if text:
            out.append((role, text))

    search = MARKUP.search
    while at < end:
        m = search(html, at)
        if m is None:
            parts.append(html[at:])
            break
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        if m[3] is None:
            if m[1]:
                parts.append(m[1])
            continue
        tag = m[3].lower()
        if m[2]:
            if tag in BLOCK:
                close()
            if tag in NESTED:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        role = stack[-1][1] if stack else OPEN
                        break
            continue
        if tag in HIDDEN and not m[4].endswith("/"):
            low = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
            if low:
                at = low.end()
            elif tag in RAW:
                break
            continue
        if tag == "br":
            parts.append(" ")
        elif tag in BLOCK:
            close()
        if tag in NESTED and tag not in VOID:
            if tag in ("p", "li"):  # an open one ends where the next begins
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        role = stack[-1][1] if stack else OPEN
                        break
                    if stack[k][0] not in ("span", "label", "button", "p"):
                        break
            inner = role_of(tag, m[4], role)
            if inner != role or tag not in ("p", "span", "label", "li"):
                if inner != role:
                    close()
                stack.append((tag, inner))
                role = inner
    close()
    return out


def shard_runs(streams: list[np.ndarray], pages: list[int], least: int = MIN_RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct runs of `least` tokens in a shard's streams: place of one, smallest and largest page that has it; and each place's run (-1 for none).

    Any longer substring that repeats consists of such runs, so they cover the same tokens. The streams, with a separator of its own after each, form one sequence, whose places the results count; prefix doubling
    ranks its suffixes by their first 2, 4, ... tokens, up to `least`. Neighbours in the suffix array with equal ranks share
    such a run. Equal streams have equal numbers in pages, as copies of a page say nothing about what is boilerplate on it.
    """
    text = np.concatenate([np.append(s, -1 - k) for k, s in enumerate(streams)])
    owner = np.concatenate([np.full(len(s) + 1, p, dtype=np.int64) for s, p in zip(streams, pages, strict=True)])
    _, rank = np.unique(text, return_inverse=True)
    done = 1
    while done < least:
        step = min(done, least - done)
        ahead = np.concatenate([rank[step:] + 1, np.zeros(step, dtype=rank.dtype)])
        _, rank = np.unique(rank.astype(np.int64) * (len(text) + 2) + ahead, return_inverse=True)
        done += step
    ends = np.append(0, np.cumsum(text < 0))
    whole = np.zeros(len(text), dtype=bool)
    if len(text) >= least:
        whole[: len(text) - least + 1] = ends[least:] == ends[:-least]
    suffixes = np.lexsort((owner, rank))
    suffixes = suffixes[whole[suffixes]]
    r = rank[suffixes]
    first = np.flatnonzero(np.append(True, r[1:] != r[:-1])[: len(r)])
    last = np.append(first[1:], len(r))[: len(first)] - 1
    run = np.full(len(text), -1, dtype=np.int64)
    run[suffixes] = np.repeat(np.arange(len(first)), last - first + 1)
    return suffixes[first], owner[suffixes[first]], owner[suffixes[last]], run


def digest(host: str, words: list[str]) -> bytes:
    """12 bytes for a run on a host; words have no line ends."""
    return blake2b(f"{' '.join(words)}\n{host}".encode("utf-8", "surrogatepass"), digest_size=12).digest()


def tokens_of(texts: list[str]) -> list[str]:
    return [w for text in texts for w in ("\0", *text.split(" "), "\0")]


def exchanged(host: str, shards: int, pages: list[int], texts: list[list[str]]) -> list[tuple[bytes, int, int]]:
    """What a shard tells of its runs: (digest, smallest page, largest page). A host's only shard tells only those on two pages."""
    number: dict[str, int] = {}
    words = [tokens_of(t) for t in texts]
    place, low, high, _ = shard_runs([np.array([number.setdefault(w, len(number)) for w in ws], dtype=np.int64) for ws in words], pages)
    flat = [w for ws in words for w in (*ws, "")]
    told = np.arange(len(place)) if shards > 1 else np.flatnonzero(low < high)
    return [(digest(host, flat[place[k] : place[k] + MIN_RUN]), int(low[k]), int(high[k])) for k in told]


def main_text(host: str, page: list[tuple[int, str]], found: set[bytes]) -> tuple[str, int]:
    """A page's articles, and its main regions and open blocks without the tokens of found runs; and how many words found runs cover.

    What a run from a neighbouring block covers of a block's end goes only with the whole block, or if it is MIN_RUN tokens long itself.
    """
    words = tokens_of([text for role, text in page if role != ARTICLE])
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    if found:
        for k in range(len(words) - MIN_RUN + 1):
            if digest(host, words[k : k + MIN_RUN]) in found:
                gone[k] += 1
                gone[k + MIN_RUN] -= 1
    covered, at, kept, repeated = np.cumsum(gone) > 0, 0, [], 0
    for role, text in page:
        if role != ARTICLE:
            n = text.count(" ") + 1
            stay: list[str] = []
            repeated += int(covered[at + 1 : at + 1 + n].sum())
            for hidden, part in groupby(range(at + 1, at + 1 + n), key=covered.__getitem__):
                run = list(part)
                if not hidden or n > len(run) < MIN_RUN:
                    stay += words[run[0] : run[-1] + 1]
            text = " ".join(stay) if role > CHROME else ""
            at += n + 2
        if text:
            kept.append(text)
    return " ".join(kept), repeated


def extract(pages: DataFrame, html: str = "html", url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """One row for each row of pages: the columns in keep (page_id, url), text, n_chars (code points) and n_repeated (words outside articles that runs cover).

    A page yields all its articles, and its main regions and open blocks without runs that its host's other pages repeat,
    in page order. Null or empty markup yields an empty text. Pages without a host form one group, dealt to shards like any
    other. Repeated rows are pages of their own with equal texts.
    """
    keep = ["page_id", "url"] if keep is None else keep
    bounded_batches(pages.sparkSession)
    flat = pages.select(*[pages[c].alias(f"k{i}") for i, c in enumerate(keep)], host_of(pages[url]).alias("host"), pages[html].alias("html"))
    sizes = flat.groupBy("host").agg(F.greatest(F.ceil(F.count("*") / SHARD_PAGES), F.ceil(F.sum(F.octet_length("html")) / SHARD_BYTES), F.lit(1)).cast("int").alias("shards"))
    own = flat.schema.fields[: len(keep)]
    names = [f.name for f in own]
    schema = T.StructType([*own, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_repeated", T.LongType())])
    large = few(sizes.where("shards > 1"))
    dealt = flat.join(large, "host", "left").withColumn("shards", F.coalesce("shards", F.lit(1))).withColumn("shard", F.pmod(F.xxhash64(*names), F.col("shards")))
    texts = T.StructField("texts", T.ArrayType(T.StringType()))

    # pages are cut twice, as only what stands outside articles is in the streams: cheaper than to keep all texts on disk;
    # texts, which have no line ends, are packed for the shuffle
    def outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = [blocks(h.as_py() or "") for h in batch.column(batch.num_columns - 1)]
            some = batch.filter(pa.array([any(r != ARTICLE for r, _ in p) for p in cuts], pa.bool_()))
            cuts = [p for p in cuts if any(r != ARTICLE for r, _ in p)]
            # pages are copies of each other if their articles are equal too
            ids = [blake2b("\0".join(t for _, t in p).encode("utf-8", "surrogatepass"), digest_size=8).digest() for p in cuts]
            found = [[t for r, t in p if r != ARTICLE] for p in cuts]
            yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array([int.from_bytes(i, "big", signed=True) for i in ids], pa.int64()), pa.array(found, pa.list_(pa.string()))], names=outside_schema.names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(h.as_py() or "") for h in batch.column(batch.num_columns - 1)]
            arrays = [pa.array([[r for r, _ in p] for p in found], pa.list_(pa.int8())), pa.array([compress("\n".join(t for _, t in p).encode(), 1) for p in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=cut_schema.names)

    def tell(key: tuple, table: pa.Table) -> pa.Table:
        found = exchanged(key[0].as_py(), table.column("shards")[0].as_py(), table.column("page").to_pylist(), table.column("texts").to_pylist())
        told = list(zip(*found, strict=True)) or [()] * 3
        return pa.table([pa.array([k.as_py()] * len(found), k.type) for k in key] + [pa.array(c, t) for c, t in zip(told, (pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["host", "shard", "run", "low", "high"])

    def decide(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        runs = set(right.column("run").to_pylist())
        found = [main_text(key[0].as_py(), list(zip(r, decompress(t).decode().split("\n"))), runs) for r, t in zip(left.column("roles").to_pylist(), left.column("packed").to_pylist(), strict=True)]
        return pa.table([*[left.column(n) for n in names], pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], names=schema.names)

    told_pages, own_pages = dealt.select("host", "shard", "shards", "html"), dealt.select(*names, "host", "shard", "html")
    outside_schema = T.StructType([*told_pages.schema.fields[:-1], T.StructField("page", T.LongType()), texts])
    cut_schema = T.StructType([*own_pages.schema.fields[:-1], T.StructField("roles", T.ArrayType(T.ByteType())), T.StructField("packed", T.BinaryType())])
    told = told_pages.mapInArrow(outside, outside_schema).groupBy("host", "shard").applyInArrow(tell, "host string, shard long, run binary, low long, high long")
    both = told.groupBy("host", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.collect_set("shard").alias("to"))
    repeated = both.where("low < high").select("host", F.explode("to").alias("shard"), "run")
    decided = own_pages.mapInArrow(cut, cut_schema).groupBy("host", "shard").cogroup(repeated.groupBy("host", "shard")).applyInArrow(decide, schema)
    return decided.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars", "n_repeated")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract of all pages: one row each, repeated rows included. Null and empty markup gives an empty text; an empty table gives no row."""
    return extract(read_table(spark, sf_dir, "pages"))
