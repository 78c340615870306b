"""Main text of web pages by the line-block distribution."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Lines of a sliding window; characters in it that always make a surge; the share of the page's largest window that does.
WINDOW, SURGE, SHARE = 3, 80, 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|math|object|textarea|title|select|iframe|canvas|audio|video)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<(?P<close>/)?(?P<name>[a-zA-Z][a-zA-Z0-9-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)"
    r"|</[^>]*(?:>|\Z)",
    re.S | re.I,
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol option optgroup p pre section summary table tbody td tfoot th thead tr ul".split()
)
_BOILERPLATE = frozenset("aside button dialog fieldset footer form header label menu nav".split())
_MAIN = frozenset(("article", "main"))
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Headings of reader comments, with or without a count; what follows up to the next heading of their level goes with them.
_COMMENTS = re.compile(
    r"(?:\d+\s+)?(?:(?:user|reader|readers'|your|latest|recent|all)\s+)?(?:comments?|replies|responses|discussion|kommentare?|commentaires?|comentarios?)(?:\s*[:(]?\s*\d*\s*\)?)"
    r"|(?:leave|write|post|add)\s+(?:a|your)\s+(?:comment|reply)",
    re.I,
)
#: Names of parts that are not the article: alone, or with a word before or after that says whose or what kind of part it is.
_PART = (
    r"(?:ads?|advert\w*|sponsor\w*|promos?|promotions?|banners?|breadcrumbs?|comments?|discussion|disqus|repl(?:y|ies)|respond|cookies?|consent|gdpr|notices?|notifications?"
    r"|alerts?|popups?|modals?|overlays?|newsletters?|subscri\w+|sidebars?|side-bars?|widgets?|related|recommend\w*|share|sharing|social|nav|navbar|navigation|menus?"
    r"|footer|masthead|copyright|pagination|pager|login|signin|signup|register|search)"
)
_BEFORE = r"(?:site|page|main|top|bottom|left|right|global|user|reader|post|article|entry|mobile|primary|secondary|sticky|js|c|l|o|m)"
_AFTER = r"(?:box|bar|block|list|section|area|container|wrapper|wrap|inner|outer|content|items?|links?|buttons?|form|panel|threads?|posts?|unit|slot|top|bottom|left|right|main|\d+)"
_HINT = re.compile(rf"(?:{_BEFORE}[_-]+)*{_PART}(?:[_-]+(?:{_PART}|{_AFTER}))*", re.I)
#: A header holds the title inside of an article, and menus elsewhere.
_HEADER = re.compile(rf"(?:(?:site|page|main|top|global|mobile|sticky|js|c|l)[_-]+)*header(?:[_-]+{_AFTER})*", re.I)
_ROLE = re.compile(r"^(?:navigation|banner|contentinfo|complementary|search|form|dialog|alert|alertdialog|menu|menubar|toolbar)$", re.I)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPACE = re.compile(r"\s+")


def _marked(name: str, attrs: str, main: bool) -> bool:
    """Whether an element's attributes name it as something other than the article."""
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in ("class", "id") and name not in ("html", "body", "article", "main", "p") and any(_HINT.fullmatch(w) or (not main and _HEADER.fullmatch(w)) for w in value.split()):
            return True
        if key == "role" and _ROLE.match(value.strip()) and name not in ("html", "body"):
            return True
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


class Line(NamedTuple):
    """A stripped line: its text, how many of its characters are inside links, and what the tags around it say; ``heading`` is a level or 0."""

    text: str
    linked: int
    junk: bool
    main: bool
    heading: int


def lines_of(page: str) -> list[Line]:
    """The page's lines, one a block, in page order.

    Every tag is stripped; block tags end a line, inline tags don't and ``br`` is white space. Character references are
    decoded after the markup is gone. A header inside of an article is part of it, since it holds the title.
    """
    out: list[Line] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []
    junk = main = links = linked = headings = level = 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        linked += len(text.strip()) if links else 0

    def end_line() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append(Line(text, min(linked, len(text)), junk > 0, main > 0, level if headings else 0))
        linked = 0

    def left(entry: tuple[str, bool, bool]) -> None:
        nonlocal junk, main, links, headings
        was, j, a = entry
        junk -= j
        main -= a
        links -= was == "a"
        headings -= was in _HEADING

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in _BLOCK:
            end_line()
        elif name == "br":
            parts.append(" ")
        if name in _VOID:
            continue
        if m["close"]:
            if any(s[0] == name for s in stack):
                while stack:
                    entry = stack.pop()
                    left(entry)
                    if entry[0] == name:
                        break
            continue
        if name in ("body", *_MAIN) and junk and not main:  # an element left open before can't hold the article
            stack = [(was, False, a) for was, _, a in stack]
            junk = 0
        if name in _BLOCK and links:  # a link left open ends with its block
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "a":
                    left(stack.pop(k))
        if name == "p":
            while stack and stack[-1][0] == "p":
                left(stack.pop())
        if name in _BLOCK or m["attrs"] or name in _BOILERPLATE or name == "a":
            is_junk = name in _BOILERPLATE and not (name == "header" and main) or _marked(name, m["attrs"], main > 0)
            is_main = name in _MAIN and not junk
            stack.append((name, is_junk, is_main))
            junk += is_junk
            main += is_main
            links += name == "a"
            if name in _HEADING:
                headings, level = headings + 1, int(name[1])
    if at < len(page):
        add(page[at:])
    end_line()
    return out


def readable(lines: list[Line]) -> list[Line]:
    """The lines without those in elements of other parts, and without reader comments under a heading that says so."""
    out, comments, was_main = [], 0, False
    for x in lines:
        if x.junk:
            continue
        if comments and (was_main != x.main or 0 < x.heading <= comments):
            comments = 0
        if x.heading and _COMMENTS.fullmatch(x.text):
            comments, was_main = x.heading, x.main
        if not comments:
            out.append(x)
    return out


def masses(lines: list[Line]) -> list[int]:
    """What each line adds to the distribution: the length of its text, against which characters inside links count twice.

    So menus and link lists have none or less. A line inside an article element gets SURGE on top, however short or linked.
    """
    return [len(x.text) - 2 * x.linked + SURGE * x.main for x in lines]


def ranges_of(m: list[int]) -> list[tuple[int, int]]:
    """Line-block distribution: ranges of lines from a surge to the dive that follows.

    The rise at a line is the sum of the run of positive masses that begins there, over WINDOW lines at most. A surge is a
    rise of SURGE or more, or of SHARE of the page's largest rise if that is less, so that a short article surges too; its foot
    reaches back over the lines right before it that have a mass, as titles do. A dive is the first line after it that has no
    mass of its own and begins a window whose whole sum isn't positive.
    """
    n = len(m)
    rise = [0] * n
    for i in range(n):
        for k in range(i, min(i + WINDOW, n)):
            if m[k] <= 0:
                break
            rise[i] += m[k]
    surge = min(SURGE, SHARE * max(rise, default=0))
    found, i = [], 0
    while i < n:
        if m[i] <= 0 or rise[i] < surge:
            i += 1
            continue
        foot, end, last = i, i + 1, found[-1][1] if found else 0
        while foot > last and m[foot - 1] > 0:
            foot -= 1
        while end < n and (m[end] > 0 or sum(m[end : end + WINDOW]) > 0):
            end += 1
        found.append((foot, end))
        i = end
    return found


def main_text(page: str | None) -> str:
    """Article text of one page: blocks joined by newlines, empty if there is none.

    Lengths and links of the lines choose ranges from surge to dive points (see :func:`ranges_of`); at the end of a range,
    headings outside of an article element go, since they head what the dive leaves. Where a page has article elements, they
    weigh their text and SURGE: a run of a range outside of them stays only if its mass is more than that, as that of a long
    text beside a teaser is.
    """
    lines = readable(lines_of(page or ""))
    m = masses(lines)
    inside = [len(x.text) for x in lines if x.main]
    bar = sum(inside) + SURGE if inside else 0
    kept = []
    for begin, end in ranges_of(m):
        while end > begin + 1 and (m[end - 1] <= 0 or (lines[end - 1].heading and not lines[end - 1].main)):
            end -= 1
        while begin < end:
            turn = next((k for k in range(begin + 1, end) if lines[k].main != lines[begin].main), end)
            if lines[begin].main or sum(m[begin:turn]) > bar:
                kept += [x.text for x in lines[begin:turn]]
            begin = turn
    return "\n".join(kept)


def _main_texts(pages: pd.Series) -> pd.Series:
    return pages.map(main_text)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with ``html`` replaced by ``text`` (the main text) and ``n_chars`` (its code points).

    * null or empty html, or a page whose text is all in menus, notices and the like: empty text, 0;
    * very long pages are read whole, in one pass; truncated markup ends with the page;
    * repeated rows get equal rows; empty table: no rows; input columns named ``text`` or ``n_chars`` are replaced.
    """
    own = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    d = pages.select(*[F.col(f"`{c}`") for c in own], pandas_udf(_main_texts, "string")("html").alias("text"))
    return d.withColumn("n_chars", F.length("text").cast("bigint"))


def op5_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
