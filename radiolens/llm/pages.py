"""Main text of web pages by nearest-URL page differencing.

A page becomes blocks of text. Pages of one host are ordered by URL path, each is paired with the neighbour
whose path shares the longer beginning, and the blocks of the two are aligned by a longest common
subsequence: what both have in the same order is the site's, not the page's, and goes. Where the markup
speaks for itself it is believed: of a page with an article its blocks stay, even if a copy of the article is
the nearest page, and blocks of menus, footers, adverts, forms and the like go even if the neighbour has
others.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolens.llm.common import Stages, whole
from radiolens.plans.ordered import LogOrder, index_log

ARTICLE, PLAIN, FURNITURE = 0, 1, 2

# Names of HTML elements by their role.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea select title".split())
ASIDE = frozenset("nav footer aside form menu dialog button fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
# Words in class, id or role that mark what is not the article.
MARKS = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promos?|banners?|nav|navbar|navigation|menus?|breadcrumbs?|"
    r"footer|footnav|sidebars?|side|aside|complementary|contentinfo|comments?|commentlist|disqus|respond|repl(?:y|ies)|"
    r"cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|newsletters?|subscribe|subscription|signup|login|share|sharing|"
    r"social|related|recommend(?:ed|ations)?|pagination|pager|search|widgets?|toolbar|copyright|disclaimer)(?:$|[^a-z])"
)
# The same, outside an article.
TOP = re.compile(r"(?:^|[^a-z])(?:header|masthead|topbar)(?:$|[^a-z])")
# The same for articles of readers.
READERS = re.compile(r"(?:^|[^a-z])(?:comments?|repl(?:y|ies))(?:$|[^a-z])")
# The same for what is the article.
MAIN = re.compile(
    r"(?:^|[^a-z])(?:articlebody|article-body|entry-content|post-content|post-body|main-content|article-content)(?:$|[^a-z])|(?:^|\s)(?:article|story)(?:\s|$)"
)

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop|aria-label|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""", re.I)
SPACE = re.compile(r"\s+").sub


def role(name: str, rest: str, zone: int) -> int | None:
    """What an element's tag says about its content, which stands in ``zone``; None: nothing."""
    if name in ("html", "body"):
        return None
    words = kind = ""
    if "=" in rest or "hidden" in rest:
        found = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(rest)}
        if "hidden" in found:
            return FURNITURE
        words = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}"
        kind = f"{words} {found.get('itemprop', '')}"
    if name in ("article", "main"):
        return FURNITURE if READERS.search(words) else ARTICLE
    if name in ASIDE:
        return FURNITURE
    if " main" in words or MAIN.search(kind):
        return ARTICLE
    if MARKS.search(words):
        return FURNITURE
    return FURNITURE if zone != ARTICLE and (name == "header" or TOP.search(words)) else None


def blocks(html: str | None) -> list[tuple[str, int]]:
    """(text, zone) of every block in page order: character references decoded, white space as one space.

    An element that is not the article's keeps that zone for all it holds, also articles; a header inside an
    article is the article's own. Comments, unfinished tags, scripts and styles are no text; a line break
    is white space. Elements may stay open: an end tag closes the nearest element of its name.
    """
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    open_: list[tuple[str, int]] = []  # elements that say something, and those of their name inside them
    zone, at, html = PLAIN, 0, html or ""

    def finish() -> None:
        if parts:
            text = SPACE(" ", unescape("".join(parts))).strip()
            if text:
                out.append((text, zone))
            parts.clear()

    while True:
        tag = TAG.search(html, at)
        if tag is None:
            parts.append(html[at:])
            break
        if tag.start() > at:
            parts.append(html[at : tag.start()])
        at, name = tag.end(), tag["name"]
        if name is None:
            continue
        name = name.lower()
        if name in RAW and not tag["close"]:
            if name in ("script", "style", "title", "textarea") or not tag["rest"].endswith("/"):
                at = _after(html, at, name)
            parts.append(" ")
            continue
        if name in BLOCKS:
            finish()
        elif name == "br":
            parts.append(" ")
        if tag["close"]:
            if any(n == name for n, _ in open_):
                while open_.pop()[0] != name:
                    pass
                zone = open_[-1][1] if open_ else PLAIN
            continue
        said = role(name, tag["rest"], zone)
        if said is None and not any(n == name for n, _ in open_) or tag["rest"].endswith("/") or name in ("br", "hr", "img", "input", "meta", "link"):
            continue
        if said is None or zone == FURNITURE:
            said = zone
        finish()
        open_.append((name, said))
        zone = said
    finish()
    return out


def _after(html: str, at: int, name: str) -> int:
    """Behind the end tag of an element whose content is no text; without one, the end of the page."""
    end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
    return end.end() if end else len(html)


def common(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    A line that repeats is told apart by how often it came before, so each line has at most one match and
    the subsequence is the longest ascending one of the matches.
    """

    def numbered(lines: list) -> list[tuple]:
        seen: dict = {}
        out = []
        for x in lines:
            seen[x] = seen.get(x, 0) + 1
            out.append((x, seen[x]))
        return out

    where = {x: j for j, x in enumerate(numbered(b))}
    ends: list[int] = []  # ends[k]: the smallest end in b of an ascending run of k + 1 matches
    last: list[int] = []  # its place in a
    before: dict[int, int] = {}
    for i, x in enumerate(numbered(a)):
        j = where.get(x)
        if j is None:
            continue
        k = bisect_left(ends, j)
        before[i] = last[k - 1] if k else -1
        if k == len(ends):
            ends.append(j)
            last.append(i)
        else:
            ends[k], last[k] = j, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def nearer(path: str, one: str | None, other: str | None) -> int:
    """0 for the path that shares the longer beginning with ``path``, 1 for the other; the first at a tie."""

    def shared(x: str | None) -> int:
        if x is None:
            return -1
        n = 0
        for a, b in zip(path, x):
            if a != b:
                break
            n += 1
        return n

    return int(shared(other) > shared(one))


def _blocks(html: Column) -> Column:
    @F.pandas_udf("text array<string>, zone array<int>, mark array<int>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            out = []
            for found in map(blocks, pages):
                texts = [t for t, _ in found]
                out.append((texts, [z for _, z in found], [zlib.crc32(t.encode("utf-8", "surrogatepass")) - (1 << 31) for t in texts]))
            yield pd.DataFrame(out, columns=["text", "zone", "mark"])

    return of(html.cast("string"))


def _shared(own: Column, path: Column, one: Column, one_path: Column, other: Column, other_path: Column) -> Column:
    @F.pandas_udf("array<int>")
    def of(own: pd.Series, path: pd.Series, one: pd.Series, one_path: pd.Series, other: pd.Series, other_path: pd.Series) -> pd.Series:
        out = []
        for a, p, b, bp, c, cp in zip(own, path, one, one_path, other, other_path):
            both = [c, b] if nearer(p, bp, cp) else [b, c]
            runs = (common(a.tolist(), x.tolist()) for x in both if x is not None)
            out.append(next((run for run in runs if len(run) < len(a)), []))  # not a copy of the page
        return pd.Series(out)

    return of(own, path, one, one_path, other, other_path)


def main_text(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id", text: str = "text") -> DataFrame:
    """``pages`` without ``html``, with ``text``: the blocks of the article in page order, joined by line breaks.

    Pages are numbered in the order of host, path, whole URL and id by one range sort, so a host with many
    pages is cut wherever the sort cuts it, and meet their two neighbours by number; only 32-bit marks of
    their blocks travel, no text. The last join brings the outcome to the blocks by key.

    NULL or empty html: empty text. NULL url: no host and no neighbour. A host with one page: structure
    alone decides. A neighbour that has all of a page's blocks is a copy and tells nothing; the other one
    is asked then. Repeated pages (same id, url and html) are one page to their neighbours, and each row
    gets its text. Pages with one URL are ordered by id. Empty table: no rows. Other columns stay; one with
    the name of ``text`` is replaced.
    """
    stages = Stages(pages.sparkSession)
    parts = F.regexp_extract(F.lower(whole(F.col(url))), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1)
    path = F.regexp_extract(whole(F.col(url)), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^#]*)", 1)
    k = F.xxhash64(F.col(key), F.col(url), F.col(html))
    cut = pages.withColumn("x k", k).withColumn("x blocks", _blocks(F.col(html)))
    slim = cut.select(
        F.col(key).alias("id"), F.col("x k").alias("k"), parts.alias("host"), path.alias("path"), whole(F.col(url)).alias("url"), F.col("x blocks.mark").alias("marks"),
    ).where("host <> ''").dropDuplicates(["id", "k"])
    order = LogOrder(by=("host", "path", "url", "id", "k"), plan="chunked")
    n = F.col(order.index)
    rows = stages.write(index_log(slim, order).select(n.alias("n"), "id", "k", "host", "path", "marks"), "pages")

    def beside(step: int, name: str) -> DataFrame:
        return rows.select((F.col("n") + step).alias("n"), F.col("host").alias(f"{name}_host"), F.col("path").alias(f"{name}_path"), F.col("marks").alias(f"{name}_marks"))

    met = rows.join(beside(1, "one"), "n", "left").join(beside(-1, "other"), "n", "left")
    own = lambda name, column: F.when(F.col(f"{name}_host") == F.col("host"), F.col(f"{name}_{column}"))
    met = met.select(
        F.col("id").alias("x id"), F.col("k").alias("x key"),
        _shared(F.col("marks"), F.col("path"), own("one", "marks"), own("one", "path"), own("other", "marks"), own("other", "path")).alias("x shared"),
    )
    met = met.where(F.size("x shared") > 0)
    joined = cut.drop(html).join(met, F.col(key).eqNullSafe(F.col("x id")) & (F.col("x k") == F.col("x key")), "left")
    none = F.array().cast("array<int>")
    joined = joined.select("*", F.col("x blocks.text").alias("x text"), F.col("x blocks.zone").alias("x zone"))
    places = F.when(F.size("x text") > 0, F.sequence(F.lit(0), F.size("x text") - 1)).otherwise(none)
    joined = joined.withColumn("x all", places).withColumn("x own", F.array_except("x all", F.coalesce("x shared", none)))
    article = F.filter("x all", lambda i: F.get("x zone", i) == ARTICLE)
    plain = F.filter("x own", lambda i: F.get("x zone", i) == PLAIN)
    joined = joined.withColumn("x article", article)
    picked = F.when(F.size("x article") > 0, F.col("x article")).otherwise(plain)
    out = F.array_join(F.transform(picked, lambda i: F.get("x text", i)), "\n")
    return joined.withColumn(text, out).drop(*[f"x {c}" for c in ("k", "blocks", "id", "key", "shared", "text", "zone", "all", "own", "article")])
