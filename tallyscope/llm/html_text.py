"""Main text of web pages by the distribution of line blocks.

Markup is stripped to lines, one for each block of the page; lines of menus, forms, notices and the like keep their place
but count no characters. Sums over a sliding window of lines surge where the article begins and dive where it ends, and
what lies between is kept. Where a page marks its article, the distribution is taken within it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lines of a window; lines of no text put where something else than the article stands.
WINDOW = 3
#: A window of so many characters is a surge; with fewer, whole sentences are only kept after one.
SURGE = 60

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|title|select|object)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?][^>]*+>",
    re.IGNORECASE | re.DOTALL,
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
SPACES = frozenset(("br", "td", "th", "option"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OTHER = frozenset("nav footer aside form menu dialog head button".split())
MAIN = frozenset(("article", "main"))
#: Elements that end tags of inline elements do not reach through; ends of blocks stop at the cells of a table.
SPECIAL = BLOCKS | {"td", "th", "button"}
CELLS = frozenset(("table", "caption", "td", "th", "button"))
TABLE = frozenset(("table", "caption", "tbody", "thead", "tfoot", "tr", "td", "th"))
#: What the start of an element ends, and what this does not reach through: the nearest, in tables the outermost.
ITEMS = SPECIAL - {"address", "div", "p"}
IMPLIED = {
    **{x: (frozenset(("p",)), CELLS) for x in BLOCKS - TABLE - {"body", "head", "html"} | {"table"}},
    **{x: (frozenset((x,)), SPECIAL - {x}) for x in ("a", "option")},
    **{x: (frozenset(("td", "th", "caption")), frozenset(("table",))) for x in ("td", "th")},
    "tr": (frozenset(("tr", "td", "th", "caption")), frozenset(("table",))),
    **{x: (TABLE - {"table"}, frozenset(("table",))) for x in ("tbody", "thead", "tfoot")},
}
ENDED = {"li": frozenset(("li",)), "dd": frozenset(("dd", "dt")), "dt": frozenset(("dd", "dt"))}
#: A form with one of these in it is a wrapper of the page.
WRAPS = re.compile(r"</form\b|<(?:article|main|nav|header|footer|aside|h1)\b|__VIEWSTATE", re.IGNORECASE)
ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"))
NAMES = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments cookie cookies disclaimer "
    "discussion disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices overlay "
    "pagination popup promo promoted promotion reader-comments related replies reply respond rail search share sharing sidebar "
    "signup social sponsor sponsored subscribe subscription tags toolbar widget widgets".split()
)
#: In an article these are words of its own as well; there they need a second name, or a word of controls, beside them.
AMBIGUOUS = frozenset("discussion form notice notices search share tags".split())
CONTROLS = frozenset("bar box button buttons icons links tools".split())
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)


def _names_other(word: str) -> bool:
    """Whether a class or id names something else than an article; `has-sidebar` only says what is beside it."""
    if word in NAMES or word in ("site-header", "page-header", "top-header"):
        return True
    first, *rest = re.split(r"[-_]+", word)
    return first not in ("has", "with", "no", "is") and not NAMES.isdisjoint({first, *rest} - {"header"})


def _other_in_main(words: list[str]) -> bool:
    """Whether those of an element's classes and ids that name something else do so in an article, too."""
    parts = {x for word in words for x in (word, *re.split(r"[-_]+", word))}
    names = parts & NAMES
    return bool(names - AMBIGUOUS) or len(names - {"notices"}) > 1 or not CONTROLS.isdisjoint(parts)


def _is_other(tag: str, attrs: str, in_main: bool) -> bool:
    """Whether an element is no part of an article, by its tag, role, class or id."""
    if tag in OTHER or (tag == "header" and not in_main):
        return True
    if tag in MAIN or tag in ("html", "body") or not attrs:
        return False
    named = []
    for name, *values in ATTR.findall(attrs):
        value, name = "".join(values).lower(), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ROLES):
            return True
        if name in ("class", "id"):
            named += [word for word in value.split() if _names_other(word)]
    return bool(named) and (not in_main or _other_in_main(named))


class _Open:
    """The open elements, with HTML's implied ends: tag, whether text in it is left out, and what the caller adds."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, int]] = []
        self.count: Counter[str] = Counter()

    def push(self, tag: str, shut: bool, at: int) -> None:
        self.stack.append((tag, shut, at))
        self.count[tag] += 1

    def cut(self, size: int) -> None:
        for tag, _, _ in self.stack[size:]:
            self.count[tag] -= 1
        del self.stack[size:]

    def _reach(self, targets: frozenset, barriers: frozenset, all_of_them: bool = False) -> int:
        """How many elements stay open if the target is ended."""
        size = len(self.stack)
        if any(self.count[x] for x in targets):
            for k in range(size - 1, -1, -1):
                tag = self.stack[k][0]
                if tag in targets:
                    size = k
                    if not all_of_them:
                        break
                elif tag in barriers:
                    break
        return size

    def after_start(self, tag: str) -> int:
        """How many elements stay open when this one starts."""
        size = len(self.stack)
        if tag in ENDED:
            size = self._reach(ENDED[tag], ITEMS)
        if tag in IMPLIED:
            size = min(size, self._reach(*IMPLIED[tag], tag in TABLE and tag != "table"))
        return size

    def after_end(self, tag: str) -> int:
        """How many elements stay open after this end tag."""
        if tag in TABLE:
            barriers = frozenset(("table",))
        else:
            barriers = frozenset() if tag in ("body", "html") else CELLS if tag in SPECIAL else SPECIAL
        return self._reach(frozenset((tag,)), barriers)


def _closed(html: str) -> set[int]:
    """Where the elements start that have an end tag of their own."""
    open_, out = _Open(), set()
    for m in TOKEN.finditer(html):
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        size = open_.after_end(tag) if m["end"] else open_.after_start(tag)
        if m["end"] and size < len(open_.stack):
            out.add(open_.stack[size][2])
        open_.cut(size)
        if not m["end"] and tag not in VOID:
            open_.push(tag, False, m.start())
    return out


def lines_of(html: str) -> list[tuple[str, int, bool]]:
    """The page's lines: text, characters that count (those of links only in an article), and whether in an article.

    Elements that are no article give no lines. `main` in one gives lines again, and so does `article` in one that has no
    end tag of its own. Inline elements are only followed in elements that are no article.
    """
    lines: list[tuple[str, int, bool]] = []
    open_ = _Open()
    stack = open_.stack
    closed: set[int] | None = None
    parts: list[str] = []
    linked = main = at = 0
    in_link = shut = False
    next_wrap: re.Match | None = None
    wrap_from = -1

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                lines.append((text, len(text) if main > 0 else max(len(text) - linked, 0), main > 0))
        linked = 0

    def gap() -> None:
        flush()
        lines.extend([("", 0, main > 0)] * WINDOW)

    def wraps(start: int) -> bool:
        nonlocal next_wrap, wrap_from
        if wrap_from < 0 or next_wrap and next_wrap.start() < start:
            next_wrap, wrap_from = WRAPS.search(html, start), start
        return bool(next_wrap) and next_wrap[0].lower() != "</form"

    def end(size: int) -> None:
        """Ends all but the outermost `size` elements."""
        nonlocal main, shut, in_link
        if size < len(stack):
            before = shut
            if not shut:
                flush()
            main -= sum(1 for tag, hidden, _ in stack[size:] if tag in MAIN and not hidden)
            open_.cut(size)
            shut = bool(stack) and stack[-1][1]
            if before and not shut:
                gap()
                in_link = False

    for m in TOKEN.finditer(html):
        if m.start() > at and not shut:
            piece = html[at : m.start()]
            parts.append(piece)
            if in_link:
                linked += len(piece.strip())
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag, ends = tag.lower(), bool(m["end"])
        was_shut = shut
        if ends or tag in IMPLIED:
            size = open_.after_end(tag) if ends else open_.after_start(tag)
            if size < len(stack):
                inline = not shut and tag not in SPECIAL and size == len(stack) - 1 and stack[-1][0] == tag
                if inline:
                    open_.cut(size)
                else:
                    end(size)
        if ends:
            if not was_shut and not shut:
                if tag == "a":
                    in_link = False
                elif tag in BLOCKS:
                    flush()
                    in_link = False
                elif tag in SPACES:
                    parts.append(" ")
            continue
        if tag in VOID:
            if not shut and tag in BLOCKS:
                flush()
                in_link = False
            elif not shut and tag in SPACES:
                parts.append(" ")
            continue
        if shut:
            again = tag == "main"
            if tag == "article":
                closed = _closed(html) if closed is None else closed
                # the outermost of the shut elements around it
                k = len(stack) - 1
                while k and stack[k - 1][1]:
                    k -= 1
                again = stack[k][2] not in closed
            if again:
                shut, in_link = False, False
                main += 1
                lines.extend([("", 0, True)] * WINDOW)
            open_.push(tag, shut, m.start())
            continue
        if not (tag == "form" and wraps(m.end())) and _is_other(tag, m["attrs"], main > 0):
            gap()
            shut = True
            open_.push(tag, True, m.start())
            continue
        if tag == "a":
            in_link = True
        elif tag in BLOCKS:
            flush()
            in_link = False
            main += tag in MAIN
        elif tag in SPACES:
            parts.append(" ")
        if tag in SPECIAL or tag == "option":
            open_.push(tag, False, m.start())
    if at < len(html) and not shut:
        parts.append(html[at:])
    flush()
    return lines


def main_text(html: str) -> str:
    """The article's blocks in page order, joined by empty lines; an empty string if there is none."""
    lines = lines_of(html)
    if any(text and inside for text, _, inside in lines):
        lines, surge = [x if x[2] else ("", 0, False) for x in lines], 1
    else:
        surge = SURGE
    counts = [0] * (WINDOW - 1) + [n for _, n, _ in lines] + [0] * (WINDOW - 1)
    sums, total = [], sum(counts[:WINDOW])  # of the window that ends with a line, then of those that follow
    for k in range(len(lines) + WINDOW - 1):
        sums.append(total)
        if k + WINDOW < len(counts):
            total += counts[k + WINDOW] - counts[k]
    kept, k = [], 0
    while k < len(lines):
        stop = k
        while stop < len(lines) and max(sums[stop : stop + WINDOW]) > 0:
            stop += 1
        # between a surge from nothing and the dive to nothing
        run = [text for text, _, _ in lines[k:stop] if text]
        if run and (max(sums[k : stop + WINDOW - 1]) >= surge or kept and run[-1][-1] in ".!?…"):
            kept.extend(run)
        k = max(stop, k + 1)
    return "\n\n".join(kept)


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, `text` and its `n_chars`.

    A null or empty page, or one without an article, has an empty text. Repeated rows stay, other columns are ignored, an
    empty table gives an empty one. One narrow pass; a page is read by one task whatever its length.
    """
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), F.coalesce(pages[html_col], F.lit("")).alias("html"))
    schema = T.StructType([rows.schema["id"], rows.schema["url"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(x.as_py()) for x in b.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), texts], ["id", "url", "text"])

    out = rows.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
