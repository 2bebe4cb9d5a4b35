"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsmith.llm.common import col

#: Lines that a window covers, and the least text of a window at which main text may begin.
WINDOW_LINES = 3
SURGE_CHARS = 40
#: What a character outside links weighs inside an article element; elsewhere it weighs 1.
ARTICLE_WEIGHT = 8

#: Elements of HTML by their part on a page.
BREAKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title noscript iframe template svg math object canvas audio video noembed xmp".split())
ASIDE = frozenset("nav footer aside form menu dialog button select head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tag may be left out, and the start tags that end them; the end of an element around them does, too.
IMPLIED = {
    "p": BREAKS - {"br"},
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
}
HOLDERS = BREAKS - VOID - frozenset(IMPLIED)
#: Words in class, id or role that name what is not the article.
MARKS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer "
    "masthead menu modal nav navbar navigation newsletter notice overlay pagination popup promo promoted recommended related "
    "respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.S
)
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PARTS = re.compile(r"[^A-Za-z0-9]+")


def _off_topic(name: str, rest: str, in_article: bool) -> bool:
    if name in ASIDE or (name == "header" and not in_article):
        return True
    if name in ("html", "body", "article", "main") or "=" not in rest:
        return False
    values = " ".join("".join(m) for m in NAMED.findall(rest))
    return not MARKS.isdisjoint(PARTS.split(values.lower()))


def page_lines(page: str) -> list[tuple[str, int, bool]]:
    """Lines of the page without markup: (text, characters outside links, inside an article element).

    Elements that are not main text leave an empty line, so that the distribution falls there;
    white space between tags makes no line.
    """
    lines: list[tuple[str, int, bool]] = []
    texts: list[str] = []
    free = link = article = deep = held = at = 0
    skipping = raw = ""
    raw_end: dict[str, re.Pattern[str]] = {}

    def flush() -> None:
        nonlocal free
        if texts:
            if text := " ".join("".join(texts).split()):
                lines.append((text, free, article > 0))
            texts.clear()
            free = 0

    def say(piece: str) -> None:
        nonlocal free
        if piece and not skipping:
            plain = html.unescape(piece) if "&" in piece else piece
            texts.append(plain)
            if not link:
                free += len(plain.strip())

    while True:
        if raw:
            closing = raw_end.setdefault(raw, re.compile(rf"</{re.escape(raw)}(?=[\s/>])[^>]*>?", re.I)).search(page, at)
            raw = ""
            if closing is None:
                break
            at = closing.end()
            continue
        tag = TAG.search(page, at)
        if tag is None:
            say(page[at:])
            break
        say(page[at : tag.start()])
        at = tag.end()
        if tag["name"] is None:
            continue
        name, ends, rest = tag["name"].lower(), tag["end"] == "/", tag["rest"]
        empty = name in VOID or rest.endswith("/") and name in ("svg", "math")
        if skipping in IMPLIED and not empty:
            # Holders opened and closed since then tell whether a tag belongs to the skipped element.
            if held == 0 and (name in HOLDERS if ends else name in IMPLIED[skipping]):
                skipping, deep = "", 0
                lines.append(("", 0, article > 0))
            elif held == 0 and ends and name == skipping:
                deep = 1
            elif name in HOLDERS:
                held += -1 if ends else 1
        if skipping:
            if name == skipping and not empty and (skipping not in IMPLIED or held == 0):
                deep += -1 if ends else 1
            if deep <= 0 or (name in ("article", "main") and not ends):
                skipping, deep = "", 0
                lines.append(("", 0, article > 0))
            if skipping or name not in ("article", "main"):
                if name in RAW and not ends and not empty:
                    raw = name
                continue
        if name in RAW and not ends and not empty:
            if name in BREAKS:
                flush()
            raw = name
            continue
        if not ends and not empty and _off_topic(name, rest, article > 0):
            flush()
            lines.append(("", 0, article > 0))
            skipping, deep, held = name, 1, 0
            continue
        if name in BREAKS:
            flush()
        if name in ("article", "main"):
            article = max(0, article + (-1 if ends else 1))
            link = 0
        elif name == "a":
            link = 0 if ends else 1
    flush()
    return lines


def main_text(page: str | None, window: int = WINDOW_LINES, surge: int = SURGE_CHARS) -> str:
    """Text between surge and dive points of the page's line-block distribution, one line per block.

    A window's sum is the weight of ``window`` lines: their characters outside links, which
    weigh more inside an article element, where links count a little too. Main text begins
    where a sum reaches ``surge`` and ends where the sum falls to zero. What began inside an
    article ends with it at the latest, and no window reaches over its edge before main text
    begins; text outside is main text if its own sum surges. Lines of links alone are kept
    inside an article only. If no sum reaches ``surge``, the run of the greatest weight is main text.
    """
    lines = page_lines(page or "")
    size = [(ARTICLE_WEIGHT - 1) * free + len(text) if inside else free for text, free, inside in lines]
    out: list[str] = []
    total, begun, start, edge, by_mark, before = 0, False, 0, 0, False, False

    def take(stop: int) -> None:
        out.extend(text for (text, _, _), n in zip(lines[start:stop], size[start:stop]) if n)

    for i in range(len(lines) + 1):  # the window of lines i - window .. i - 1 leaves, that of i - window + 1 .. i enters
        inside = i < len(lines) and lines[i][2]
        if inside != before:
            if begun and by_mark:
                take(i)
                begun = False
            if not begun:
                total, edge = 0, i
            before = inside
        if i < len(lines):
            total += size[i]
        if i - window >= edge:
            total -= size[i - window]
        if not begun and total >= surge:
            begun, start, by_mark = True, max(edge, i - window + 1), inside
        if begun and (total == 0 or i == len(lines)):
            take(i + 1)
            begun = False
    if not out and any(size):
        start, stop = _heaviest(size, window)
        take(stop)
    return "\n".join(out)


def _heaviest(size: list[int], window: int) -> tuple[int, int]:
    """The run of the greatest weight, the first of equals; ``window`` lines without weight end a run."""
    best, run, begin, idle = (0, 0, 0), 0, 0, 0
    for i, n in enumerate([*size, *[0] * window]):
        if n and not run:
            begin = i
        run, idle = run + n, 0 if n else idle + 1
        if idle >= window:
            best = max(best, (run, -begin, -i))
            run = 0
    return -best[1], min(len(size), -best[2])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole HTML.

    NULL or empty HTML, and pages without main text, give an empty text. NULL ids and
    urls stay NULL, repeated rows are extracted each, an empty table gives an empty
    result, other columns are not read. Unclosed elements end with the page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )

    picked = pages.select(col(id_col).cast("bigint").alias("page_id"), col(url_col).alias("url"), col(html_col).alias("html"))
    out = picked.mapInArrow(run, "page_id bigint, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
