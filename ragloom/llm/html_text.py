"""Main text of web pages by line-block distribution.

Markup is stripped first: scripts, styles, forms, menus, headers, footers and sidebars go with their text, known by their tag, and block elements cut
what is left into lines. Over the lines' text lengths a window slides; text begins where the window's sum surges and ends where it dives to nothing. Runs of lines
with ``SURGE`` characters in a window are kept, or the run with the most text if there is none. Lines in the same container as a kept run belong to its text too, so a short
end after a form or an advert stays. An element that is taken out leaves a window of empty lines, so it parts what stands before it from what stands after it.

Elements whose class, id or role has a word for adverts, notices, comments and the like are taken out, however long they are. Words of layout (``sidebar``, ``widget``) make a suspect, no more: it is
taken out unless it holds an article that counts, or at least half of the page's text. Words count as parts of a name in containers and as whole names elsewhere, so a heading
``related-work`` or a paragraph ``share-price`` is text.

An ``article`` is the text, whatever else the page holds and however short it is, unless it is a card: one whose text is mostly links, whose class says so, or one of several none of which has
over half of their text. All its lines are kept but those taken out. ``main`` is weaker: if the text in it is at least as long as all other text, lines outside count as empty, and the windows decide inside; else
it decides nothing. Without either the windows decide over the whole page. Links count as text only inside an article or ``main`` that counts.

Character references are decoded once, white space inside a line becomes one space, and lines are joined by an empty line.

Edge cases: a null or empty page, and a page without text, give the empty string; broken, unclosed or truncated markup is read as far as it goes, in time in proportion to its length;
repeated rows are kept; an empty table gives an empty result; only page_id, url and html are read. Pages of any length are read whole.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 80

# Elements whose text is never an article's.
RAW = ("script", "style", "noscript", "template", "textarea", "select", "iframe", "object", "svg", "canvas", "title")
STRIPPED = {"nav", "footer", "aside", "form", "dialog", "menu", "button", "head", "header", "datalist", "audio", "video"}
# Words in class, id or role of an element that may not be part of the article; those of reader comments; those of layout, which may hold the article.
STRIPPED_WORDS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar aside footer header masthead notice notices alert cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup "
    "share sharing social comment comments disqus replies respond related recommended widget pagination pager toolbar login search complementary contentinfo".split()
)
# Elements that begin and end a line.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
COMMENTS = set("comment comments disqus replies respond".split())
LAYOUT = set("header masthead sidebar aside widget banner overlay modal toolbar complementary pagination pager".split())
# Words of an article that only leads to another one.
CARDS = set("card cards teaser teasers preview related recommended promo".split())
# Open elements that an element of the same row ends, if they are the last to be opened.
ENDS = {"li": {"li", "p"}, "p": {"p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = set("article blockquote body div dd fieldset figure html main section table td".split())
NEVER_STRIPPED = {"html", "body", "article", "main"}
ARTICLES = {"article", "main"}
#: Elements in whose class, id or role a word counts as part of a name.
PARTED = CONTAINERS | {"aside", "dl", "footer", "header", "iframe", "ol", "ul"}

_MARKUP = re.compile(
    r"<!--(?:.*?-->|.*$)"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])[^>]*+>(?:.*?</(?P=raw)\s*+>|.*$)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+)>"
    r"|<[/!?a-zA-Z][^>]*+>"
    r"|<[/!?a-zA-Z][^<>]*+$",
    re.S | re.I,
)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def _words(tag: str, rest: str) -> set[str]:
    """The words of an element's class, id or role."""
    found: set[str] = set()
    for name in (n for x in _NAMED.findall(rest) for n in "".join(x).lower().split()):
        parts = re.split(r"[-_]+", name) if tag in PARTED else [name]
        if parts[0] not in ("has", "no", "with", "without"):
            found.update(parts)
    return found


class Lines:
    """The lines of a page in order, each with its characters outside links and the numbers of its container, its innermost suspect and its innermost article or ``main`` (0: none)."""

    def __init__(self) -> None:
        self.text: list[str] = []
        self.plain: list[int] = []
        self.container: list[int] = []
        self.suspect: list[int] = []
        self.article: list[int] = []
        #: Of each suspect: the one around it, whether it may hold the article.
        self.around, self.layout = [0], [True]
        #: Of each article or main: the one around it, its suspect, whether it is an article, whether it may count.
        self.outer, self.within, self.is_article, self.open = [0], [0], [False], [False]

    def add(self, text: str, plain: int, container: int, suspect: int, article: int) -> None:
        for column, value in ((self.text, text), (self.plain, plain), (self.container, container), (self.suspect, suspect), (self.article, article)):
            column.append(value)

    def decided(self) -> tuple[list[bool], list[bool], bool]:
        """Of each suspect, whether its lines go; of each article or main, whether its lines are the text's; whether the latter are articles."""
        size, tied = [0] * len(self.around), [False] * len(self.around)
        for plain, at in zip(self.plain, self.suspect):
            size[at] += plain
        gone = [False] * len(size)
        for at in range(1, len(size)):  # a suspect has a larger number than the one around it
            gone[at] = gone[self.around[at]] or not self.layout[at]
        text, plain = [0] * len(self.outer), [0] * len(self.outer)
        for words, n, at, suspect in zip(self.text, self.plain, self.article, self.suspect):
            if not gone[suspect]:
                text[at] += len(words)
                plain[at] += n
        for at in range(len(text) - 1, 0, -1):
            text[self.outer[at]] += text[at]
            plain[self.outer[at]] += plain[at]
        top = [at for at in range(1, len(text)) if self.is_article[at] and text[at] and not self._in_article(at)]
        most = sum(text[at] for at in top)
        counts = [False] * len(text)
        for at in top:
            counts[at] = self.open[at] and 2 * plain[at] >= text[at] and 2 * text[at] > most
        articles = any(counts)
        if not articles:
            mains = [at for at in range(1, len(text)) if not self.is_article[at] and not counts[self.outer[at]] and text[at]]
            if mains and 2 * sum(plain[at] for at in mains if not self.outer[at]) >= plain[0]:
                for at in mains:
                    counts[at] = True
        inside = [False] * len(text)
        for at in range(1, len(text)):
            inside[at] = counts[at] or inside[self.outer[at]]
            if counts[at]:
                tied[self.within[at]] = True
        for at in range(len(size) - 1, 0, -1):
            size[self.around[at]] += size[at]
            tied[self.around[at]] |= tied[at]
        for at in range(1, len(size)):
            main = self.layout[at] and (tied[at] or 2 * size[at] >= size[0] > 0)
            gone[at] = gone[self.around[at]] or not main
        return gone, inside, articles

    def _in_article(self, at: int) -> bool:
        while at := self.outer[at]:
            if self.is_article[at]:
                return True
        return False


def lines_of(page: str) -> Lines:
    lines = Lines()
    text: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool]] = []  # open elements; whether each is stripped by its tag; whether it is a suspect
    open_tags: Counter[str] = Counter()
    stripped = article = links = opened = suspect = 0
    within = [0]  # numbers of the open containers

    def end_line() -> None:
        nonlocal linked
        words = " ".join(entities.unescape("".join(text)).split())
        if words:
            lines.add(words, max(0, len(words) - linked), within[-1], suspect, article)
        text.clear()
        linked = 0

    def gap() -> None:
        end_line()
        for _ in range(WINDOW):
            lines.add("", 0, 0, suspect, article)

    def pop() -> None:
        nonlocal stripped, article, links, suspect
        tag, cut, suspected = stack.pop()
        open_tags[tag] -= 1
        stripped -= cut
        links -= tag == "a"
        if tag in CONTAINERS or suspected:
            end_line()
        if tag in CONTAINERS:
            within.pop()
        if tag in ARTICLES:
            end_line()
            article = lines.outer[article]
            gap()
        if suspected:
            suspect = lines.around[suspect]

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not stripped:
            text.append(piece)
            if links:
                linked += len(piece)

    at = 0
    for m in _MARKUP.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS or tag == "br" and not text:
            end_line()
        elif tag == "br":
            add(" ")
        if m["close"]:
            if open_tags[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
        elif tag not in VOID and not m["rest"].endswith("/"):
            while stack and stack[-1][0] in ENDS.get(tag, ()):
                pop()
            cut = tag in STRIPPED and not (tag == "header" and article > 0)
            names = _words(tag, m["rest"]) if m["rest"] and not cut and not stripped else set()
            words = names & (COMMENTS if tag in NEVER_STRIPPED else STRIPPED_WORDS)
            if cut and not stripped:
                gap()
            if words:
                gap()
                lines.around.append(suspect)
                lines.layout.append(words <= LAYOUT)
                suspect = len(lines.around) - 1
            if tag in ARTICLES:
                gap()
                for column, value in ((lines.outer, article), (lines.within, suspect), (lines.is_article, tag == "article"), (lines.open, not names & CARDS)):
                    column.append(value)
                article = len(lines.outer) - 1
            if tag in CONTAINERS:
                end_line()
                opened += 1
                within.append(opened)
            stack.append((tag, cut, bool(words)))
            open_tags[tag] += 1
            stripped += cut
            links += tag == "a"
    add(page[at:])
    end_line()
    return lines


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article of a page, its blocks joined by an empty line."""
    if not page:
        return ""
    lines = lines_of(page)
    gone, inside, articles = lines.decided()
    # The gap before a suspect stands outside it and stays.
    left = [k for k, at in enumerate(lines.suspect) if not gone[at]]
    marked = any(inside)
    own = [k for k in left if lines.text[k] and inside[lines.article[k]]]
    if articles:
        return "\n\n".join(lines.text[k] for k in own)
    sizes = [(len(lines.text[k]) if inside[lines.article[k]] else 0) if marked else lines.plain[k] for k in left]
    runs: list[tuple[int, int, int, int]] = []  # first line, line after the last, largest window, whole size
    i = 0
    while i < len(sizes):
        if not sizes[i]:
            i += 1
            continue
        first = i
        while i < len(sizes) and any(sizes[i : i + window]):
            i += 1
        peak = max(sum(sizes[k : k + window]) for k in range(first, i))
        runs.append((first, i, peak, sum(sizes[first:i])))
    kept = [r for r in runs if r[2] >= surge] or [max(runs, key=lambda r: r[3])] if runs else []
    places = {lines.container[left[k]] for a, b, *_ in kept for k in range(a, b) if sizes[k]}
    chosen = {k for a, b, *_ in kept for k in range(a, b)} | {k for a, b, *_ in runs for k in range(a, b) if lines.container[left[k]] in places}
    return "\n\n".join(lines.text[left[k]] for k in sorted(chosen) if lines.text[left[k]] and (not marked or inside[lines.article[left[k]]]))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars``: a row for each row of ``pages``."""

    @F.arrow_udf("string")
    def text_of(html: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py()) for x in html], pa.string())

    found = pages.select("page_id", "url", text_of(F.col("html").cast("string")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
