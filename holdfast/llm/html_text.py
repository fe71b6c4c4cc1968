"""Main text of web pages by line-block distribution.

Method: markup is stripped so that every block element with text becomes a line; nesting alone adds
none. Lines of elements that never hold the article (menus, headers, footers, sidebars, notices,
adverts, forms, comments, scripts, styles, hidden parts) are left out, and so is all that stands
outside <article> or <main> where a page has one; a class or id word leaves out no element that holds
most of the page's text. Lines that are mostly links count as empty. Text lengths are summed over
sliding windows of WINDOW lines; where the sums leave zero is a surge point, where they come back to zero a
dive point, and the lines between the first and last text of the two are a stretch. The end of an
<article> or <main> ends its stretches. The container of the fullest stretch is kept, and of others
those whose stretches hold at least THIN of its text (a page may hold several articles; a teaser is
thinner). In a page without containers a stretch that thin is left out unless it has a heading.
Kept are all text lines of kept stretches, with paragraphs, headings and list items of links among
them, so only WINDOW or more other link lines in a row part two stretches.

Cases: null, empty or textless html gives an empty text; unclosed and wrongly nested tags are
closed by their parents; a `<` that opens no tag is text; any length is read in one linear pass;
repeated rows are extracted as often as they occur; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from holdfast.llm.tables import small_batches

WINDOW = 3
THIN = 0.2  # of the best stretch's text
LINKED = 0.6  # share of a line's characters in links that makes it a menu

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|math|object)\b[^>]*(?<!/)>"
    r".*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<rest>(?>[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>|<[a-z][^>]*>", re.I | re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'"""
                       r"""|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")

# Elements of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr "
    "ul".split())
NEVER = frozenset("head title nav footer aside form menu dialog button select option search "
                  "canvas audio video datalist".split())
# An open one of these ends where the next one starts.
SELF_ENDING = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}),
               "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}),
               "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"})}
CONTAINER = frozenset("div section ul ol dl table p span header details figure blockquote li td "
                      "center".split())
# Blocks of running text, in which mostly linked words can be the article's own.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote figcaption caption li dt dd td th pre".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Inside an article these are running text, whatever their class, unless it says advert.
RUNNING = frozenset("p span li td blockquote figure".split())
ADVERTS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo".split())
SURE, NAMED = "sure", "named"
# Words in class or id that mark what is not the article, on any CONTAINER.
ASIDE = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo cookie cookies gdpr popup modal "
    "overlay newsletter subscribe signup login nav navbar breadcrumb breadcrumbs sidebar footer "
    "masthead topbar toolbar pagination pager".split())
# Words that also name parts of an article: they count on a GROUP, alone or beside FURNITURE.
UNSURE = frozenset(
    "advertising advertisements promotion banner consent notice alert subscription navigation menu "
    "rail share sharing social related recommended recommendations trending widget skip disclaimer "
    "copyright legal search".split())
GROUP = frozenset("div ul ol dl span header center table".split())
FURNITURE = UNSURE | ASIDE | frozenset(
    "area bar block box btn button buttons container content field icon icons input item items link "
    "links list main media module nav panel post posts primary secondary site top bottom left right "
    "wrap wrapper".split())
REPLIES = frozenset("comment comments disqus reply replies respond".split())
THREAD = CONTAINER - frozenset("p span td figure blockquote".split())
ROLES = frozenset("navigation menu menubar banner complementary contentinfo search alert dialog "
                  "alertdialog toolbar".split())
# A class such as has-sidebar or comments-open tells of the page, not of the element.
FIRST = frozenset("has with no without is show hide".split())
LAST = frozenset("open opened closed enabled disabled on off".split())


def _marks(rest: str) -> tuple[list[list[str]], set[str], bool]:
    """(words of each class and id; roles; whether the element is hidden)."""
    names, roles, hidden = [], set(), False
    for name, value in ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            names += [[w.lower() for w in SPLIT.split(x) if w] for x in value.split()]
        elif name == "role":
            roles.update(value.lower().split())
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        else:
            hidden |= name == "hidden" or value.lower() == "true"
    return names, roles, hidden


def _not_article(name: str, rest: str, inside: bool) -> str:
    """Why an element holds no article: `sure` by what it is, `named` by a class, id or role, or
    not at all."""
    if name in NEVER or name == "header" and not inside:
        return SURE
    if not rest or rest.isspace():
        return ""
    names, roles, hidden = _marks(rest)
    if hidden or name not in CONTAINER:
        return SURE if hidden else ""
    aside = ADVERTS if inside and name in RUNNING else ASIDE
    for words in names:
        if not words or words[0] in FIRST or words[-1] in LAST:
            continue
        if any(w in aside or w in REPLIES and name in THREAD for w in words):
            return NAMED
        if name in GROUP and FURNITURE.issuperset(words) and not UNSURE.isdisjoint(words):
            return NAMED
    return "" if ROLES.isdisjoint(roles) else NAMED


Line = tuple[str, bool, int, float, str]


def page_lines(html: str) -> list[Line]:
    """Lines of a page: (text, may be article, number of the <article> or <main> or 0, share in
    links, block)."""
    lines: list[tuple[str, bool, int, float, str, tuple[int, ...]]] = []
    # (element, surely left out, container, block, numbers of the elements left out by name)
    stack: list[tuple[str, bool, int, str, tuple[int, ...]]] = []
    opened = 0
    parts: list[str] = []
    linked = 0
    links = 0

    def state() -> tuple[bool, int, str, tuple[int, ...]]:
        return stack[-1][1:] if stack else (False, 0, "", ())

    def flush() -> None:
        nonlocal linked
        out, inside, block, named = state()
        text = " ".join(unescape("".join(parts)).split())
        if text:
            lines.append((text, not out, inside, linked / len(text), block, named))
        parts.clear()
        linked = 0

    def close(to: int) -> None:
        nonlocal links
        if any(x[0] in BLOCK for x in stack[to:]):
            flush()
        links -= sum(x[0] == "a" for x in stack[to:])
        del stack[to:]

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if links:
                linked += len(text.strip())

    at = 0
    for m in TAG.finditer(html):
        add(html[at:m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                # an inline element never reaches over the block that holds it
                if stack[k][0] in BLOCK and name not in BLOCK:
                    break
            if name in ("p", "br"):
                parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK:
            flush()
            ends = SELF_ENDING.get(name)
            # a block also ends an open paragraph
            for k in range(len(stack) - 1, -1, -1):
                own = stack[k][0]
                if own == "p" or ends and own in ends:
                    close(k)
                    break
                if own in BLOCK:
                    break
        if name in VOID or m["rest"].endswith("/") and name not in BLOCK:
            continue
        opened += 1
        out, inside, block, named = state()
        if not inside and (name in ("article", "main") or "role" in m["rest"] and (
                "main" in _marks(m["rest"])[1])):
            inside = opened
        why = _not_article(name, m["rest"], bool(inside))
        stack.append((name, out or why == SURE, inside, name if name in BLOCK else block,
                      (*named, opened) if why == NAMED else named))
        links += name == "a"
    add(html[at:])
    flush()
    held: dict[int, int] = {}
    for text, may, _, _, _, named in lines:
        for number in named if may else ():
            held[number] = held.get(number, 0) + len(text)
    whole = sum(len(x[0]) for x in lines if x[1])
    most = {number for number, n in held.items() if 2 * n > whole}
    return [(text, may and most.issuperset(named), inside, share, block)
            for text, may, inside, share, block, named in lines]


def stretches(sizes: np.ndarray) -> list[tuple[int, int]]:
    """(first, past the last) text line between each surge and dive point."""
    padded = np.concatenate([[0], np.cumsum(sizes)])
    # sums over windows of lines; each window is named by its last line
    ends = np.arange(1, len(sizes) + WINDOW)
    sums = padded[np.minimum(ends, len(sizes))] - padded[np.maximum(ends - WINDOW, 0)]
    live = np.concatenate([[False], sums > 0, [False]])
    surges = np.flatnonzero(~live[:-1] & live[1:])
    # the last line with text stands WINDOW - 1 lines before the last live window
    dives = np.flatnonzero(live[:-1] & ~live[1:]) - WINDOW + 1
    return list(zip(surges.tolist(), dives.tolist()))


def main_text(html: str | None) -> str:
    lines = [x for x in page_lines(html or "") if x[1]]
    if any(x[2] for x in lines):
        lines = [x for x in lines if x[2]]
    sizes = np.array([len(text) if share < LINKED else 0 for text, _, _, share, _ in lines], "i8")
    inside = np.array([x[2] for x in lines], "i8")
    # (container, first, past the last, text)
    found = [(number, first + at[0], first + at[1], int(sizes[first + at[0]:first + at[1]].sum()))
             for number in dict.fromkeys(inside.tolist())
             for first in [int(np.argmax(inside == number))]
             for at in stretches(sizes[inside == number])]
    text: dict[int, int] = {}
    for number, _, _, n in found:
        text[number] = text.get(number, 0) + n
    best = max(text.values(), default=0)
    fullest = max((n for *_, n in found), default=0)
    kept = []
    for number, a, b, n in found:
        if number:  # an article is kept whole, or not at all
            keep = text[number] >= THIN * best
        else:
            keep = n >= THIN * fullest or any(lines[k][4] in HEADINGS for k in range(a, b)) and any(
                sizes[k] and lines[k][4] not in HEADINGS for k in range(a, b)) or any(
                lines[k][4] == "h1" for k in range(a, b))
        if keep:
            kept += [k for k in range(a, b) if sizes[k] or lines[k][4] in PROSE]
    return "\n".join(lines[k][0] for k in sorted(kept))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    small_batches(pages.sparkSession)
    source = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"),
                          pages[html_col].cast("string").alias("html"))
    schema = T.StructType([source.schema["page_id"], source.schema["url"],
                           T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(x) for x in texts], pa.int64())], names=schema.names)

    return source.mapInArrow(run, schema)
