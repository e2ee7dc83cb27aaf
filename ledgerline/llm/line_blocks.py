"""Main text of HTML pages by the distribution of text over line blocks (operator 3).

Markup goes, with everything inside elements that never hold an article; block elements end lines. The sum of text lengths
over a sliding window of lines rises where an article begins (surge) and falls where it ends (dive); the text between them
stays. Text of links counts little, and lines inside an article element count as long ones, so short paragraphs
and headings of a marked article do not end it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

#: Lines of a window; text that a window holds at a surge, at least; share of the surge below which it dives.
WINDOW, SURGE, DIVE = 3, 80, 0.15
#: Elements whose content is never shown as text, and elements around an article but not of it.
HIDDEN = frozenset("script style noscript template svg iframe object canvas math head title select option button textarea form fieldset datalist audio video map".split())
AROUND = frozenset("nav footer aside menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that the next one of their kind ends.
SELF_ENDING = frozenset("p li dt dd tr td th option".split())
#: Names of boxes that are not the article.
BOX = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|side-?bar\w*|comments?|commentlist|respond|repl(?:y|ies)|discussion|disqus|cookies?\w*|"
    r"consent|gdpr|notice\w*|alert|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend\w*|menu\w*|nav|navbar|navigation|"
    r"breadcrumbs?|footer\w*|header|masthead|topbar|widget\w*|popup|modal|overlay|paywall|search\w*|toolbar|skip|pagination|pager|tags?|legal|copyright|disclaimer)(?=$|[\s_-])",
    re.IGNORECASE)
#: Names that say what a box around the article has or lacks.
LAYOUT = re.compile(r"^(?:has|with|without|no|is|hide|show)[_-]", re.IGNORECASE)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|style|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())


def _kind(name: str, attributes: str, in_article: bool) -> str:
    """What an element means: 'out' (not the article), 'in' (marked as the article), '' (nothing)."""
    if name in HIDDEN or name in AROUND or (name == "header" and not in_article):
        return "out"
    found = {k.lower(): (v or "").strip("\"'").lower() for k, v in ATTRIBUTE.findall(attributes)} if attributes else {}
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        return "out"
    role = found.get("role", "")
    if role in ROLES:
        return "out"
    marked = name in ("article", "main") or role in ("main", "article") or found.get("itemprop") == "articlebody"
    if name not in ("html", "body", "h1", "p"):
        names = f"{found.get('class', '')} {found.get('id', '')}".split()
        if any(BOX.search(x) for x in names if not LAYOUT.match(x)):
            return "out"
    return "in" if marked else ""


def lines_of(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters of links, inside a marked article, heading) of each line with text."""
    out: list[tuple[str, int, bool, bool]] = []
    parts: list[str] = []
    links, at = 0, 0
    open_: list[tuple[str, str]] = []
    outside = inside = in_link = heading = 0

    def end_line() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, links, inside > 0, heading > 0))
            parts.clear()
        links = 0

    def count(name: str, kind: str, step: int) -> None:
        nonlocal outside, inside, in_link, heading
        outside += step * (kind == "out")
        inside += step * (kind == "in")
        in_link += step * (name == "a")
        heading += step * (name in ("h1", "h2", "h3"))

    def close(name: str) -> None:
        for i in range(len(open_) - 1, -1, -1):
            if open_[i][0] == name:
                end_line() if name not in INLINE else None
                while len(open_) > i:
                    count(*open_.pop(), -1)
                return
            if open_[i][0] in ("article", "main", "body", "table", "ul", "ol") and name in SELF_ENDING:
                return

    size = len(page)
    while at < size:
        tag = TAG.search(page, at)
        stop = tag.start() if tag else size
        if stop > at and not outside:
            parts.append(page[at:stop])
            links += (stop - at) * (in_link > 0)
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if name not in INLINE or name == "br":
            end_line() if not outside else None
        if tag[1]:
            close(name)
            continue
        if name in VOID:
            continue
        if name in ("script", "style", "textarea", "title", "noscript", "iframe") and not tag[3].rstrip().endswith("/"):
            end = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            continue
        if name in SELF_ENDING:
            close(name)
        kind = _kind(name, tag[3], inside > 0)
        if kind != "" and not outside:
            end_line()
        open_.append((name, kind))
        count(name, kind, 1)
    if not outside:
        end_line()
    return out


def main_text(page: str) -> str:
    """The text between surges and dives, lines joined by one space; '' if a page has none."""
    lines = lines_of(page)
    if not lines:
        return ""
    marked = any(x[2] for x in lines)
    weight = [(SURGE if inside else 0) + max(0, len(text) - 2 * links) if inside or not marked else 0 for text, links, inside, _ in lines]
    n = len(lines)
    sums = [sum(weight[i : i + WINDOW]) for i in range(n)]
    top = max(sums)
    if not top:
        return ""
    surge = min(SURGE, max(1, top // 2))
    keep = [False] * n
    i = 0
    while i < n:
        if sums[i] < surge or weight[i] < surge * DIVE:
            i += 1
            continue
        j = i
        while j < n and sums[j] >= surge * DIVE:
            j += 1
        last = max(k for k in range(i, min(n, j + WINDOW)) if weight[k] and k < max(j, i + 1)) if any(weight[i:j]) else i
        begin = i
        while begin and lines[begin - 1][3] and not keep[begin - 1] and not marked:
            begin -= 1
        keep[begin : last + 1] = [True] * (last + 1 - begin)
        i = max(j, i + 1)
    return " ".join(line[0] for line, k in zip(lines, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars. Null html counts as empty and has an empty text; repeated rows are
    extracted each. No pages: no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) if x else "" for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op3_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
