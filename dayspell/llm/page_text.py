"""Main text of web pages: structure first, then repeated suffixes of each host's token streams.

Markup says most: scripts, menus, forms, adverts and comments are dropped where they are marked as such; where a page marks
its article, only that is kept, else all open blocks. Then every page is judged by its host: all that its pages print, outside
articles and inside, is cut into suffixes of up to `least` tokens. Runs that different pages print outside articles are boilerplate
wherever they stand, and so are runs that most of the host's different articles hold. Copies of an article on one host are
content: an article that shares most of its runs in this way is no different one.

Spark groups the suffixes by hash: those of one host that begin alike are one group, reduced to its first and last page before
the shuffle, so a host or a notice that holds a third of all rows needs no large task.
"""

from __future__ import annotations

import hashlib
import html as html_entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspell.llm.common import staged
from dayspell.llm.shingles import pieces, shingle_rows

MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<svg\b(?:[^>]*\s)?/>"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|object|textarea|select|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^'">])*)>""", re.S | re.I)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.S | re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME_TAGS = frozenset("nav footer aside form button head menu dialog".split())
ARTICLE_TAGS = frozenset(("article", "main"))
#: Words of class, id and role that name what is not main text (fixed values).
CHROME_NAMES = re.compile(
    r"(?:^|\s|(?<!has)(?<!with)(?<!without)(?<!no)[_-])(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|promo(?:tion|s)?|banners?|cookies?|consent|gdpr|"
    r"notices?|alerts?|popups?|modals?|overlay|newsletter|subscri(?:be|ption)|sign-?up|log-?in|menus?|nav|navbar|navigation|"
    r"breadcrumbs?|sidebars?|widgets?|related|recommend(?:ed|ations)?|share|sharing|social|comments?|disqus|repl(?:y|ies)|respond|"
    r"discussion|footers?|masthead|toolbar|pagination|pager|search|skip-link|contentinfo|complementary|disclaimer)(?:$|[\s_-])", re.I)
#: Of these, words that a wrapper of the whole page may carry too (fixed values): an article inside counts where the page has no other.
WRAPPER_NAMES = re.compile(r"(?:^|[\s_-])(?:cookies?|consent|gdpr|overlay|menus?|nav|navbar|navigation|sidebars?|footers?|masthead|toolbar|search|"
                           r"banners?|notices?|alerts?)(?:$|[\s_-])", re.I)
ARTICLE_NAMES = re.compile(r"(?:^|\s)(?:articleBody|main)(?:$|\s)", re.I)
#: Ends of elements that authors leave out: such a tag ends an open one of the same kind.
SELF_ENDING = frozenset("p li dt dd tr td th option thead tbody tfoot".split())
#: Words of 64 bits that tell which suffixes repeat (2 MB).
WORDS = 1 << 18
#: Repeated suffixes of pages that are broadcast, at most.
FEW = 200_000
#: Suffixes of articles that a task holds at a time.
HELD = 4_000_000


def _named(attrs: str) -> tuple[str, bool, bool]:
    """class, id and role in one string; whether the element is an article by name; whether it is hidden."""
    names, article, hidden = [], False, False
    for key, *values in ATTRIBUTE.findall(attrs):
        value, key = next(filter(None, values), ""), key.lower()
        if key in ("class", "id", "role"):
            names.append(value)
        if key in ("itemprop", "role") and ARTICLE_NAMES.search(value):
            article = True
        hidden |= key == "hidden" or (key == "aria-hidden" and value.lower() == "true")
    return " ".join(names), article, hidden


def blocks_of(page: str | None) -> list[tuple[str, str]]:
    """(zone, text) of every visible block in page order; the zone is `article`, `open`, `chrome`, `soft` (chrome by a name that
    wrappers carry too) or `inner` (an article inside such a wrapper).

    Character references are decoded, white space inside a block becomes one space. Unclosed tags end with the
    element around them; a stray end tag is ignored."""
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, str]] = []  # open block elements with their zones
    zone, last = "open", 0
    page = page or ""

    def flush() -> None:
        if parts:
            text = " ".join(html_entities.unescape("".join(parts)).split())
            if text:
                out.append((zone, text))
            parts.clear()

    for m in MARK.finditer(page):
        if m.start() > last:
            parts.append(page[last : m.start()])
        last = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["raw"]:
                parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
            continue
        attrs = m["attrs"]
        if tag in VOID:
            continue
        if m["close"]:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
            if at >= 0:
                before = stack[:at]
                if tag in INLINE and any(s[0] not in INLINE for s in stack[at + 1 :]):
                    before += stack[at + 1 :]  # wrongly nested: blocks inside stay open
                after = before[-1][1] if before else "open"
                if tag not in INLINE or after != zone:
                    flush()
                stack[:] = before
                zone = after
            elif tag not in INLINE:
                flush()
            continue
        names, by_name, hidden = _named(attrs) if attrs and attrs != "/" else ("", False, False)
        if tag in SELF_ENDING:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
            inner = {s[0] for s in stack[at + 1 :]}
            if at >= 0 and not inner & {"ul", "ol", "table", "dl", "div", "section", "article", "main", "nav", "aside", "footer"}:
                flush()
                del stack[at:]
                zone = stack[-1][1] if stack else "open"
        new = zone
        if zone != "chrome":
            told = names and tag not in ("html", "body", "main") and CHROME_NAMES.findall(names)
            if hidden or tag in CHROME_TAGS or (tag == "header" and zone not in ("article", "inner")):
                new = "chrome"
            elif told:
                wraps = tag not in ARTICLE_TAGS and len(WRAPPER_NAMES.findall(names)) >= len(told) and zone in ("open", "soft")
                new = "soft" if wraps else "chrome"
            elif tag in ARTICLE_TAGS or by_name:
                new = "inner" if zone in ("soft", "inner") else "article"
        if tag not in INLINE or new != zone:
            flush()
        if not attrs.endswith("/"):
            stack.append((tag, new))
            zone = new
    if last < len(page):
        parts.append(page[last:])
    flush()
    return out


def _parsed(width: int):
    """Per page: the blocks of its article, or its open blocks if it marks none; the digest of what it prints outside articles,
    and the hashes of the first `width` tokens of every suffix there. `_common` and `_suffixes_of_blocks` cut those of the blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            rows, around = [], []
            for page in batch["html"]:
                found = blocks_of(page)
                article = [t for z, t in found if z == "article"] or [t for z, t in found if z == "inner"]
                outside = [t for z, t in found if z not in ("article", "inner")]
                digest = int.from_bytes(hashlib.blake2b("\n".join(outside).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
                rows.append((bool(article), article or [t for z, t in found if z == "open"], digest))
                around.append(outside)
            yield pd.concat([batch.drop(columns="html").reset_index(drop=True), pd.DataFrame(rows, columns=["marked", "blocks", "page"])],
                            axis=1).assign(suffixes=_distinct(around, width))

    return run


def _distinct(pages: list[list[str]], width: int) -> list[np.ndarray]:
    """Per page the different suffixes of its blocks."""
    found = list(shingle_rows([block for blocks in pages for block in blocks], width))
    ends = np.cumsum([0, *map(len, pages)]).tolist()
    return [(np.unique(np.concatenate(found[a:b])) if b > a else np.zeros(0, dtype=np.uint64)).view(np.int64)
            for a, b in zip(ends, ends[1:], strict=False)]


def _judged(marked: bool, blocks: np.ndarray, width: int) -> list[str]:
    """The blocks whose runs count; short ones of an article, such as its title, may stand in a menu as well."""
    return [b for b in blocks if not marked or b.count(" ") >= width - 1]


def _common(width: int):
    """Suffixes that more than half of a host's articles hold among those that the task holds at a time. What most of all its
    articles hold is among them, however the articles are dealt."""

    def told(held: dict[str, list[np.ndarray]]) -> Iterator[pd.DataFrame]:
        for host, articles in held.items():
            suffixes, n = np.unique(np.concatenate(articles), return_counts=True)
            yield pd.DataFrame({"host": host, "suffix": suffixes[2 * n > len(articles)]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = {}, 0
        for batch in pieces(batches):
            for host, found in zip(batch["host"], _distinct([_judged(True, b, width) for b in batch["blocks"]], width), strict=True):
                held.setdefault(host, []).append(found)
                size += len(found)
            if size > HELD:
                yield from told(held)
                held, size = {}, 0
        yield from told(held)

    return run


def _kept(width: int):
    """The blocks' tokens that no repeated run covers, joined in page order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for blocks, repeated in zip(batch["blocks"], batch["repeated"], strict=True):
                blocks = list(blocks)
                if not len(repeated):
                    texts.append(" ".join(blocks))
                    continue
                marks = np.sort(np.asarray(repeated, dtype=np.int64).view(np.uint64))
                kept = []
                for block, found in zip(blocks, shingle_rows(blocks, width), strict=True):
                    tokens = block.split(" ")
                    hit = np.isin(found, marks)
                    covered = np.zeros(len(tokens) + 1, dtype=np.int64)
                    for at in np.flatnonzero(hit):
                        covered[at] += 1
                        covered[min(at + width, len(tokens))] -= 1
                    open_tokens = [t for t, c in zip(tokens, np.cumsum(covered), strict=False) if c == 0]
                    if open_tokens:
                        kept.append(" ".join(open_tokens))
                texts.append(" ".join(kept))
            yield batch[["page_id", "url"]].assign(text=texts)

    return run


def main_texts(pages: DataFrame, least: int = 8) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages` (page_id, url, html).

    Null or empty html gives an empty text. Blocks are joined in page order by one space. Runs of `least` tokens that two
    different pages of the host have outside their articles are removed: on pages without a marked article everywhere (whole
    shorter blocks too), in marked articles where most of the host's different articles, three at least, hold the run (a
    teaser prints the run of one). Runs that only articles have are removed where most of the host's different articles, three at
    least, hold them; here an article more than half of whose runs are held by most is a copy and not a different one. Pages with
    the same tokens count as one page. A null url's host is the empty one. Repeated rows and equal
    or null ids give a row each; an empty table gives an empty result; other columns are not read.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:]*://([^/?#]*)", 1))
    base = pages.select("page_id", "url", host.alias("host"), "html")
    kind = base.schema["page_id"].dataType.simpleString()
    parsed = staged(base.mapInPandas(_parsed(least), f"page_id {kind}, url string, host string, marked boolean, blocks array<string>, "
                                     "page long, suffixes array<long>").withColumn("at", F.monotonically_increasing_id()))
    repeated = (parsed.select("host", "page", F.explode("suffixes").alias("suffix")).groupBy("host", "suffix")
                .agg(F.min("page").alias("first"), F.max("page").alias("last")).where("first <> last"))

    # one row of every different article
    keyed = parsed.withColumn("row", F.xxhash64("host", "marked", "blocks")).select("page_id", "url", "host", "marked", "row", "blocks", "at")
    marked = keyed.where("marked")
    again = marked.groupBy("host", "row").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first <> last")
    copies = staged(marked.select("host", "row", "at").join(again, ["host", "row"]).where("at <> first").select("at"))
    once = marked.select("at", "host", "row", "blocks").join(F.broadcast(copies) if _few(copies) else copies, "at", "left_anti")
    articles = once.groupBy("host").agg(F.count("*").alias("articles"))
    common = once.select("host", "blocks").mapInPandas(_common(least), "host string, suffix long")
    told = staged(repeated.select("host", "suffix", F.lit(True).alias("outside")).union(common.withColumn("outside", F.lit(False)))
                  .groupBy("host", "suffix").agg(F.max("outside").alias("outside")))
    # one bit per such suffix, of a fixed size, keeps most others from the join
    seen = np.zeros(WORDS, dtype=np.int64)
    bits = (told.groupBy(F.expr(f"shiftright(suffix, 6) & {WORDS - 1}").alias("at"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(suffix & 63 as int)))").alias("bits")).toPandas())
    seen[bits["at"].to_numpy(dtype=np.int64)] = bits["bits"].to_numpy(dtype=np.int64)

    # each page's own repeated suffixes, found through its blocks; equal rows share them
    own = staged(keyed.select("host", "marked", "row", "blocks")
                 .mapInPandas(_suffixes_of_blocks(least, seen), "host string, marked boolean, row long, runs int, suffix long")
                 .join(told, ["host", "suffix"]).where("marked or outside").distinct())
    inside = own.where("marked")
    most = (inside.groupBy("host", "suffix").agg(F.count("*").alias("n"), F.max("outside").alias("outside")).where("n > 2")
            .join(articles, "host").where("2 * n > articles"))
    # of what only articles hold, different articles decide
    held = inside.join(most.select("host", "suffix"), ["host", "suffix"]).select("host", "row", "runs", "suffix", "outside")
    alike = held.groupBy("host", "row", "runs").agg(F.count("*").alias("n")).where("2 * n > runs").select("host", "row")
    different = (articles.join(alike.groupBy("host").agg(F.count("*").alias("alike")), "host", "left")
                 .select("host", (F.col("articles") - F.coalesce("alike", F.lit(0))).alias("different")))
    alone = (held.where("not outside").join(alike, ["host", "row"], "left_anti").groupBy("host", "suffix").agg(F.count("*").alias("n"))
             .where("n > 2").join(different, "host").where("2 * n > different").select("host", "suffix"))
    spread = most.where("outside").select("host", "suffix").union(alone)
    runs = staged(inside.join(spread, ["host", "suffix"], "left_semi").select("host", "row", "suffix")
                  .union(own.where("not marked").select("host", "row", "suffix")))
    own = runs.groupBy("host", "row").agg(F.collect_set("suffix").alias("repeated"))
    if _few(runs):  # then the texts need no shuffle
        own = F.broadcast(own)
    judged = (keyed.join(own, ["host", "row"], "left")
              .select("page_id", "url", "blocks", F.coalesce("repeated", F.array().cast("array<long>")).alias("repeated"))
              .mapInPandas(_kept(least), f"page_id {kind}, url string, text string"))
    return judged.withColumn("n_chars", F.length("text").cast("long"))


def _few(rows: DataFrame) -> bool:
    return rows.limit(FEW + 1).count() <= FEW


def _suffixes_of_blocks(width: int, seen: np.ndarray):
    """Per page those of its suffixes that `seen` has, each with the number of all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            pages = [_judged(m, b, width) for m, b in zip(batch["marked"], batch["blocks"], strict=True)]
            for host, marked, row, every in zip(batch["host"], batch["marked"], batch["row"], _distinct(pages, width), strict=True):
                found = every[(seen[(every >> 6) & (WORDS - 1)] >> (every & 63)) & 1 == 1]
                if len(found):
                    yield pd.DataFrame({"host": host, "marked": marked, "row": row, "runs": len(every), "suffix": found})

    return run
