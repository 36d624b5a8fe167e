"""Operator 1, main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element. Text that markup itself declares to be no article
(menus, forms, notices, comments, ...) is left out, text of links counts nothing. Over the remaining
lines the text lengths are summed in a sliding window; where the sums surge the main text begins, where
they dive it ends, and the text between is kept. A region in an article or main element is widened to that
element, so short closing or opening lines are not lost. Regions outside of such elements are kept if they hold
more text than those inside; else they are left out.

Class and id names only advise: ``no-sidebar`` or ``comments-open`` mark nothing, and where leaving out forms and elements with
longer names (``sidebar-layout-x``) leaves no surge and no article, these elements are opened, level by level, and the sums
decide. Elements whose whole name marks them (``comments``, ``sidebar-left``) stay out.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines per window; the window's sum that is a surge (characters outside links).
WINDOW, SURGE = 3, 90
#: Characters outside links from which on a further article without a surge is kept if it closes with a full stop.
SHORT = 20
#: Levels of marked elements that are opened one by one where nothing else has text; after these all are.
LEVELS = 8

BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas audio video select".split())
#: Elements that are never the article. A header inside an article holds its title and is kept.
APART = frozenset("head nav footer aside form button dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id names that mark boilerplate, compared with whole words of the names.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr "
    "header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promotion recommended recommendations "
    "related reply respond replies share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: Those of them that also stand in names of content (share-price, related-work): they count only among words of MARKED and PLAIN.
WEAK = frozenset("banner disclaimer header notice notices overlay promo promotion related reply replies share sharing skip social subscription widget widgets".split())
PLAIN = frozenset("area bar block bottom box btn button buttons col column container content div fixed group holder icon icons inner item items left link links list main module outer page panel post posts right row section site sticky text top wrap wrapper".split())
#: Whole class or id names of wrappers that hold an article, whatever else they are called.
CONTENT = frozenset("content article main post entry story body".split())
MAIN = frozenset("article main".split())
#: Words that turn a marking word beside them into a statement on the page: before it, after it.
BEFORE = frozenset("no not non without with has have hide show below after".split())
AFTER = frozenset("open opened closed free required enabled disabled".split())
#: A line that only says whose the page is.
OWNER = re.compile(r"(?:©|\(c\)|copyright\b)\s*(?:©|\(c\))?\s*\d{4}.{0,160}|©.{0,160}", re.I | re.S)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*'|['\"])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _boilerplate(tag: str, attrs: str, in_main: bool) -> str:
    """"firm" for an element that is no part of the text, "soft" for one that may yet be opened, else empty."""
    if tag == "form":
        return "soft"
    if tag in APART or tag == "header" and not in_main:
        return "firm"
    if not attrs or tag in ("html", "body") or tag in MAIN:
        return ""
    found = ""
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return "firm"
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return "firm"
        if name in ("class", "id"):
            marked = MARKED - {"header"} if in_main else MARKED  # an article's own header holds its title
            names = [[x.lower() for x in _NAME.findall(n)] for n in value.split()]
            if any(_content(n) for n in names):
                continue
            marks = [_marks(n, marked) for n in names]
            found = "firm" if "firm" in marks else "soft" if "soft" in marks else found
    return found


def _content(words: list[str]) -> bool:
    """Whether a name of these words is that of a wrapper of content."""
    return not CONTENT.isdisjoint(words) and all(w in CONTENT or w in PLAIN for w in words)


def _marks(words: list[str], marked: frozenset) -> str:
    """"firm" or "soft" if a name of these words marks boilerplate; it is firm if it has no other words."""
    found = [w for i, w in enumerate(words) if w in marked and not (i and words[i - 1] in BEFORE) and not (i + 1 < len(words) and words[i + 1] in AFTER)]
    whole = bool(found) and all(w in marked or w in PLAIN for w in words)
    return "firm" if whole else "soft" if any(w not in WEAK for w in found) else ""


def lines(page: str, opened: set[int] | None = None, closed: set[int] | None = None) -> list[tuple[str, int, int]]:
    """The page's lines as (text, characters outside links, number of the outermost article or main element, or 0).

    Softly marked elements are left out unless the place of their tag is in ``opened`` (None: all are opened); the places
    of those left out are added to ``closed``.
    """
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    plain = at = skip_depth = main = n_main = main_depth = links = 0
    skip_tag = raw = ""

    def flush():
        nonlocal plain
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, plain, main))
        parts.clear()
        plain = 0

    def take(text: str):
        nonlocal plain
        if text and not skip_tag:
            parts.append(_html.unescape(text))  # a reference ends with its run of text
            if not links:
                plain += len(text.strip())

    find = _TOKEN.search
    while m := find(page, at):
        if not raw:
            take(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        close = bool(m[1])
        if skip_tag == "p" and not close and tag in BLOCK:
            skip_tag = ""  # a paragraph ends where the next block begins
        if skip_tag:
            if tag == skip_tag and not m[0].endswith("/>"):
                skip_depth += -1 if close else 1
                if not skip_depth:
                    skip_tag = ""
            elif not close and tag in RAW:
                at = _raw_end(page, tag, at)
            elif close and tag in ("body", "html") or close and main and tag in MAIN:
                skip_tag = ""  # what was left open ends with its parent
            if skip_tag or not (close and tag in MAIN):
                continue
        if not close and tag in RAW:
            if tag in BLOCK:
                flush()
            if not m[0].endswith("/>"):
                at = _raw_end(page, tag, at)
            continue
        if tag in BLOCK:
            flush()
        if tag == "a":
            links = 0 if close else 1
        if tag in MAIN:
            if close and main:
                main_depth -= 1
                if not main_depth:
                    main = 0
            elif not close:
                if not main:
                    n_main += 1
                    main = n_main
                main_depth += 1
            continue
        if not close and tag not in VOID and (mark := _boilerplate(tag, m[3], bool(main))):
            if m[0].endswith("/>"):
                continue
            if mark == "soft":
                if opened is None or m.start() in opened:
                    continue
                if closed is not None:
                    closed.add(m.start())
            flush()
            skip_tag, skip_depth = tag, 1
    take(page[at:])
    flush()
    return out


def _raw_end(page: str, tag: str, at: int) -> int:
    m = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
    return m.end() if m else len(page)


def spans(weights: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """(surge, dive) line numbers: from the first line with text of a window at ``surge`` or more up to where a whole window is empty."""
    sums, total = [], sum(weights[:window])
    for i in range(len(weights)):
        sums.append(total)
        total += (weights[i + window] if i + window < len(weights) else 0) - weights[i]
    out, i = [], 0
    while i < len(weights):
        if sums[i] >= surge and weights[i]:
            j = i
            while j < len(weights) and sums[j]:
                j += 1
            out.append((i, j))
            i = j
        i += 1
    return out


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text of one page; empty if there is none."""
    if not page:
        return ""
    closed: set[int] = set()
    got = lines(page, set(), closed)
    if closed and not _has_text(got, window, surge):
        opened, level = set(closed), 1
        while True:
            more: set[int] = set()
            wider = lines(page, opened if level <= LEVELS else None, more)
            if _has_text(wider, window, surge):
                got = wider
                break
            if not more or level > LEVELS:
                break  # no surge anywhere: what stands outside of marked elements is all there is
            opened |= more
            level += 1
    return " ".join(_kept(got, window, surge))


def _has_text(got: list[tuple[str, int, int]], window: int, surge: int) -> bool:
    return any(m and w for _, w, m in got) or bool(spans([w for _, w, _ in got], window, surge))


def _kept(got: list[tuple[str, int, int]], window: int, surge: int) -> list[str]:
    """The lines of the main text."""
    weights = [w for _, w, _ in got]
    found = spans(weights, window, surge)
    size: dict[int, int] = {}
    for a, b in found:
        for _, w, m in got[a:b]:
            size[m] = size.get(m, 0) + w
    inside = {m for m in size if m}
    outside = size.get(0, 0) > sum(size[m] for m in inside)
    # Elements with a surge of their own are kept whole; teasers of a few words have none.
    held = {m for m in inside if size[m] >= surge} or (set() if outside else inside)
    if not found:
        held = {m for _, _, m in got if m}
    if found and outside:
        within = {k for a, b in found for k in range(a, b)}
        keep = [k for k, (_, _, m) in enumerate(got) if m in held or k in within]
    elif held:
        held |= _short_articles(got) - held
        keep = [k for k, (_, _, m) in enumerate(got) if m in held]
    else:
        keep = [k for k, (_, w, _) in enumerate(got) if w]
    while keep and not got[keep[-1]][2] and OWNER.fullmatch(got[keep[-1]][0]):
        keep.pop()  # the owner's line right after the text
    return [got[k][0] for k in keep]


def _short_articles(got: list[tuple[str, int, int]]) -> set[int]:
    """Articles too short for a surge that are text all the same: most of it outside links, and closed like a sentence."""
    plain, every, last = {}, {}, {}
    for t, w, m in got:
        if m:
            plain[m], every[m], last[m] = plain.get(m, 0) + w, every.get(m, 0) + len(t), t
    return {m for m in plain if plain[m] >= SHORT and 2 * plain[m] > every[m] and last[m].endswith((".", "!", "?", "…", "。"))}


def extract(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """``page_id, url, text, n_chars`` per row.

    Null, empty and textless pages have empty text; very long pages are read whole; ids and urls pass through as they
    are, repeated rows too. Other columns play no part, whatever their names. An empty table gives an empty result. Of
    regions with equal text those inside article elements are kept.
    """

    def run(batches):
        for b in batches:
            text = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    got = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return got.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html_text(spark, sf_dir: str) -> DataFrame:
    """The contract's query over all of ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
