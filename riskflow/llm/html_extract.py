"""Main text of web pages by the distribution of text over line blocks.

1. Markup is stripped in one pass over the page. What is left are lines, one
   per block element, in page order. Scripts, styles, forms and other elements
   without prose leave nothing. Boilerplate elements - menus, headers, footers,
   sidebars, notices, adverts and reader comments, known by element, role or
   name - leave a blank line, as does each border of a sectioning element. A role
   or name never silences an element with more than half of the page's text
   outside links (comments: only if it holds no ``h1`` or ``main`` either).
2. A line's length is its characters outside links. The block sum of a line is
   the sum over the window of lines that begins there.
3. A surge is a line where the block sum rises from nothing; its dive is where
   the sum falls back to zero, after as many blank lines as the window is
   wide. The text between a surge and its dive is one
   region. Where the regions that the page marks as its article (``article``,
   ``main``) hold at least half of the text, they are the article: marks, not
   sums, decide there. Else the regions that hold a block sum above
   ``SURGE_SHARE`` of the page's largest are kept, and the marked ones.

White space inside a line becomes one space; lines are joined by two line
feeds. Nothing else is dropped or capped. Pages are independent: no shuffle.

Defined cases: a null page is empty; a page without text gives the empty text;
a truncated page counts as far as it goes, a tag cut at its end is markup;
unclosed elements end with their parent. Repeated rows give equal results; only
id, url and html are read; an empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import ship

__all__ = ["extract_text", "lines_of", "main_regions", "extract_pages"]

WINDOW = 3
SURGE_SHARE = 0.2

# Fixed values of the markup language: what elements are.
RAW = frozenset("script style title textarea xmp noembed noframes iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("""script style title textarea xmp noembed noframes iframe head template noscript svg math
    canvas object audio video map select datalist button dialog""".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table
    tbody td tfoot th thead tr ul""".split())
SECTION = frozenset("article body div main section".split())
CLOSES_P = BLOCK - {"body", "html"}
SAME_LEVEL = {"li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
              "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}),
              "option": frozenset({"option"})}
SCOPE = frozenset("ul ol dl table article main section div body".split())
# What names parts of a page that are not the article.
BOILERPLATE = frozenset("nav aside footer menu".split())
BOILERPLATE_ROLES = frozenset("""navigation banner contentinfo complementary search form dialog alertdialog alert
    menu menubar toolbar""".split())
BOILERPLATE_NAMES = frozenset("""ad ads adbox advert adverts advertisement advertisements advertising adsense banner
    banners promo promos promoted promotion sponsor sponsors sponsored sidebar sidebars sidenav menu menus submenu
    nav navbar navigation topnav breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice
    notices notification notifications alert popup modal overlay newsletter subscribe subscription signup social
    share sharing sharebar related recommended recommendations comment comments commentlist disqus respond replies
    widget widgets toolbar pagination pager copyright disclaimer login searchform searchbox""".split())
# Parts of an article whose name may hold "header".
ARTICLE_NAMES = frozenset("article content entry post story title".split())
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())

_TAG = re.compile(r"""<!--(?s:.*?)(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"""
                  r"""|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*'|["'])*)(?:>|\Z)""")
_BODY = re.compile(r"<(?:h1|article|main)\b|</form", re.IGNORECASE)
_ATTR = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_NAME = re.compile(r"[a-z0-9]+")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTR.finditer(text)}


def _boilerplate(tag: str, attrs: str, in_article: bool) -> str:
    """"" or why an element is not part of the article."""
    if tag in BOILERPLATE or tag == "header" and not in_article:
        return tag
    if not attrs or "=" not in attrs:
        return ""
    a = _attributes(attrs)
    if a.get("role", "").lower() in BOILERPLATE_ROLES:
        return "role"
    if tag in ("html", "body", "main"):
        return ""
    names = set(_NAME.findall(f"{a.get('class', '')} {a.get('id', '')}".lower()))
    if names & COMMENTS:
        return "comments"
    if tag in ("article", "h1"):
        return ""
    if "header" in names and not in_article and not names & ARTICLE_NAMES:
        return "name"
    return "name" if names & BOILERPLATE_NAMES or {"side", "bar"} <= names else ""


class _Lines:
    """Lines with their length outside links and whether the article holds them."""

    def __init__(self):
        self.lines: list[tuple[str, int, bool]] = []
        self.parts: list[str] = []
        self.linked: list[str] = []

    def text(self, s: str, link: bool) -> None:
        self.parts.append(s)
        if link:
            self.linked.append(s)

    def end_line(self, inside: bool) -> None:
        if self.parts:
            words = " ".join(_html.unescape("".join(self.parts)).split())
            if words:
                linked = len(" ".join(_html.unescape(" ".join(self.linked)).split())) if self.linked else 0
                self.lines.append((words, max(0, len(words) - linked), inside))
            self.parts, self.linked = [], []

    def gap(self) -> None:
        if self.lines:
            self.lines.append(("", 0, False))


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, length outside links, inside the marked article) per line."""
    lines, wrong = _read(page, frozenset())
    return _read(page, wrong)[0] if wrong else lines


def _read(page: str, spared: frozenset) -> tuple[list[tuple[str, int, bool]], frozenset]:
    """The lines, and where elements begin that a role or name silences though
    they hold most of the text; those in ``spared`` are not silenced."""
    out, stack = _Lines(), []          # stack: (tag, reason it is silent or "")
    silent = article = links = 0
    at, opened = 0, Counter()          # opened: how often each element is on the stack
    # text outside links and quiet elements so far, h1 and main so far; their values where elements on the
    # stack begin; and what elements silenced by role or name hold
    seen = heads = quiet = 0
    begins, held = [], []

    def pop_to(k: int) -> None:
        nonlocal silent, article, links, quiet
        while len(stack) > k:
            tag, why = stack.pop()
            begin, before, above = begins.pop()
            quiet -= why == "quiet"
            if why in ("role", "name") or why == "comments" and heads > above:
                held.append((begin, seen - before))
            opened[tag] -= 1
            if tag in BLOCK and not silent:
                out.end_line(article > 0)
            if why:
                silent -= 1
                if not silent and why != "quiet":
                    out.gap()
            elif not silent:
                if tag in SECTION:
                    out.gap()
                links -= tag == "a"
                article -= tag in ("article", "main")

    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            if not silent:
                out.text(page[at:], links > 0)
            if not quiet and not opened["a"]:
                seen += len(page[at:].strip())
            break
        if m.start() > at:
            if not silent:
                out.text(page[at:m.start()], links > 0)
            if not quiet and not opened["a"]:
                seen += len(page[at:m.start()].strip())
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if opened[tag]:
                pop_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            elif tag == "p" and not silent:
                out.end_line(article > 0)
            continue
        if tag in VOID:
            if not silent:
                if tag == "hr":
                    out.end_line(article > 0)
                else:
                    out.text(" " if tag == "br" else "", links > 0)
            continue
        if tag in CLOSES_P and opened["p"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop_to(i)
                if i >= len(stack) or stack[i][0] in SCOPE:
                    break
        if tag in SAME_LEVEL:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in SAME_LEVEL[tag]:
                    pop_to(i)
                    break
                if stack[i][0] in SCOPE:
                    break
        if tag in ("article", "main") and silent and not any(w in ("comments", "aside") for _, w in stack) \
                and _boilerplate(tag, m[3], False) != "comments":
            # an article inside a menu, a header or a form that was left open
            pop_to(next(i for i, (_, w) in enumerate(stack) if w))
        if tag in BLOCK and not silent:
            out.end_line(article > 0)
        why = "quiet" if tag in SILENT else _boilerplate(tag, m[3], article > 0)
        if m.start() in spared:
            why = ""
        if tag == "form" and not why:
            # a form around the whole page is no form to leave out
            holds = _BODY.search(page, at)
            why = "" if holds and holds[0][1] != "/" else "quiet"
        if m[3].endswith("/") and tag in ("svg", "math", "iframe"):
            continue
        if why:
            silent += 1
            if silent == 1 and why != "quiet":
                out.gap()
        elif not silent:
            if tag in SECTION:
                out.gap()
            links += tag == "a"
            article += tag in ("article", "main")
        stack.append((tag, why))
        begins.append((m.start(), seen, heads))
        heads += tag in ("h1", "main")
        quiet += why == "quiet"
        opened[tag] += 1
        if tag in RAW:
            raw_end = re.compile(f"</{tag}", re.IGNORECASE).search(page, at)
            at = raw_end.start() if raw_end else len(page)
    pop_to(0)
    out.end_line(False)
    return out.lines, frozenset(begin for begin, n in held if 2 * n > seen)


def main_regions(lines: list[tuple[str, int, bool]], window: int = WINDOW,
                 surge_share: float = SURGE_SHARE) -> list[tuple[int, int]]:
    """[begin, end) of the regions between a surge and its dive that are kept."""
    length = [n for _, n, _ in lines]
    n = len(lines)
    upto = [0]
    for x in length:
        upto.append(upto[-1] + x)
    blocks = [upto[min(n, i + window)] - upto[i] for i in range(n)]
    filled = [i for i in range(n) if lines[i][0]]
    regions, begin = [], None
    for k, i in enumerate(filled):
        if begin is None:
            begin = i                                   # surge: text after blank lines
        if k + 1 == len(filled) or filled[k + 1] - i > window:
            regions.append((begin, i + 1))              # dive: a window of blank lines follows
            begin = None
    marked = [r for r in regions if any(lines[i][2] for i in range(*r))]
    if marked and 2 * sum(upto[e] - upto[b] for b, e in marked) >= upto[-1]:
        return marked
    floor = surge_share * max(blocks, default=0)
    return [r for r in regions if r in marked or max(blocks[r[0]:r[1]]) >= floor and any(length[r[0]:r[1]])]


def extract_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    lines = lines_of(page)
    return "\n\n".join(lines[i][0] for r in main_regions(lines) for i in range(*r) if lines[i][0])


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """Per row: id, url, ``text``, ``n_chars``."""
    ship(df)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            texts = [extract_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array(map(len, texts), pa.int64())], names=["_id", "_url", "text", "n_chars"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    return (rows.mapInArrow(run, f"_id {kind}, _url string, text string, n_chars bigint")
                .withColumnRenamed("_id", id_col).withColumnRenamed("_url", url_col))
