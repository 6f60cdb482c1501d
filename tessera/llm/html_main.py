"""Main text of web pages by two-pass block rules.

A page is read once as a stream of tags and texts and cut into blocks at block-level tags. Containers that are
not the article by their tag, role or class (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments) are left out whole; one that only its class, or being a form, tells apart stays if it has more than
half of the page's text and no block outside such containers is good or in an article. The first pass classifies each block by its link density,
length and stop-word density as good, bad or undecided, wherever it stands. The second pass gives each undecided
block the label of its nearest decided neighbours: good if both sides agree or the nearer one is good, and by the
page's head and tail bad. Article and main elements are evidence for that: an undecided block inside is bad only
between two bad ones of the inside, one outside on such a page is good only between two good ones of the outside. Blocks of links
inside an article are good between good ones, so a list of sources stays and links to other articles at its end don't.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import text_batches

# Frequent function words of the languages served.
STOP_WORDS = {
    "en": "a about all also an and any are as at be been but by can did do for from had has have he her his how i if in into is it its more my no not of on one or our she so some that the their them then there they this to up was we were what when which who will with would you your",
    "fr": "à au aussi aux avec ce cette ces comme dans de des du elle en est et être il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses si son sont sur un une vous",
    "de": "aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist man mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur",
    "es": "a al como con de del e el ella en era es esta este fue ha hay la las le lo los más me mi muy no nos o para pero por que qué se sin sobre su sus también te un una y ya",
}
ALL_STOP_WORDS = frozenset(w for words in STOP_WORDS.values() for w in words.split())

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("script style noscript template head title nav header footer aside form iframe object svg canvas button select option textarea dialog menu audio video noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br-block caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An end tag that is missing is implied where one of these begins inside the same element.
CLOSES = {"p": BLOCK, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"})}
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert".split())
#: Words of a class or id that mark what is not the article.
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager sidebar aside widget widgets footer masthead share sharing social newsletter subscribe subscription signup login comment comments comentarios commentaires kommentare disqus respond replies reply related recommended recommendations toolbar topbar skip disclaimer".split()
)
#: Words that such a name can be joined with ("site-footer", "sidebar-right"); others ("has-sidebar", "menu-open") tell of a state.
JOINED_NAMES = frozenset(
    "area bar block blocks bottom box card col column container content global group inner item items left link links list main outer page panel post posts primary right secondary section site strip top wrap wrapper zone".split()
)
KEPT = frozenset({"html", "body", "article", "main"})

TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*)(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
WORD = re.compile(r"[^\W\d_]+")

LINKS_HIGH, LINKS_ALL, STOPS_HIGH, STOPS_LOW, SHORT, LONG = 0.4, 0.9, 0.25, 0.1, 60, 160


#: Label of a block of links inside an article, which is as the article's blocks around it.
LINKS = 2


class Block:
    __slots__ = ("inside", "linked", "parts", "within")

    def __init__(self, inside: bool, within: tuple[int, ...]):
        self.parts: list[str] = []
        self.linked = 0
        self.inside = inside
        self.within = within  # containers around it that are left out by their class or as forms


def _marked(names: str) -> bool:
    """Whether one of the names of a class or id attribute says, as a whole, that this isn't the article."""
    for name in names.split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if not DROPPED_NAMES.isdisjoint(words) and all(w in DROPPED_NAMES or w in JOINED_NAMES for w in words):
            return True
    return False


STAYS, BY_NAME, OUT = 0, 1, 2


def _left_out(tag: str, attributes: str, nested: bool) -> int:
    """OUT, BY_NAME (for its class, or as a form) or STAYS; nested: inside an article, where a further article can be a comment or a teaser."""
    if tag in DROPPED:
        return BY_NAME if tag == "form" else OUT
    if tag in KEPT and not (nested and tag == "article") or not attributes or "=" not in attributes and "hidden" not in attributes:
        return STAYS
    by_name = False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id") and _marked(value):
            by_name = True
        if name == "role" and value in DROPPED_ROLES or name == "aria-hidden" and value == "true":
            return OUT
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return OUT
    if re.search(r"(?:^|\s)hidden(?:\s|/|$)", re.sub(r"=\s*(\"[^\"]*\"|'[^']*'|\S+)", "", attributes)):
        return OUT
    return BY_NAME if by_name else STAYS


def blocks(page: str) -> list[Block]:
    """The blocks of a page that stand in no container that is left out for sure."""
    found: list[Block] = []
    stack: list[str] = []
    named: list[tuple[int, int]] = []  # containers left out by name: depth of the stack, number
    numbers = 0
    dropped = links = inside = at = 0  # dropped: depth of the stack at the container that is left out
    current: Block | None = None

    def text(raw: str) -> None:
        nonlocal current
        if dropped or not raw:
            return
        said = html_lib.unescape(raw) if "&" in raw else raw
        if current is None:
            if not said.strip():
                return
            current = Block(inside > 0, tuple(x for _, x in named))
            found.append(current)
        current.parts.append(said)
        if links:
            current.linked += len("".join(said.split()))

    def pop_to(depth: int) -> None:
        nonlocal dropped, links, inside, current
        while len(stack) > depth:
            tag = stack.pop()
            if tag in BLOCK:
                current = None
            links -= tag == "a"
            inside -= tag in ("article", "main")
            if dropped > len(stack):
                dropped = 0
            while named and named[-1][0] > len(stack):
                named.pop()

    size = len(page)
    while at < size:
        m = TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        if m[1]:
            if tag in stack:
                pop_to(len(stack) - 1 - stack[::-1].index(tag))
            elif tag == "p":
                current = None
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            if end is None:
                at = size
            else:
                close = page.find(">", end.start())
                at = size if close < 0 else close + 1
            continue
        if stack and tag in CLOSES.get(stack[-1], ()):
            pop_to(len(stack) - 1)
        elif tag in BLOCK and tag not in ("li", "dt", "dd", "tr", "td", "th") and "p" in stack and not dropped:
            depth = len(stack) - 1 - stack[::-1].index("p")
            if not any(t in BLOCK for t in stack[depth + 1 :]):  # inline elements that were left open
                pop_to(depth)
        if tag in BLOCK:
            current = None
        if tag == "br" and current is not None and not dropped:
            current.parts.append(" ")
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            if tag == "hr":
                current = None
            continue
        stack.append(tag)
        if tag == "a":
            links += 1
        if not dropped and (out := _left_out(tag, m[3], inside > 0)) and not (tag == "header" and inside):
            if out == OUT or tag not in BLOCK:
                dropped = len(stack)
            else:
                numbers += 1
                named.append((len(stack), numbers))
        if tag in ("article", "main"):
            inside += 1
    return found


def _first_pass(block: Block, text: str) -> int:
    """1 good, -1 bad, 0 undecided, LINKS for links inside an article."""
    size = len(text)
    links = block.linked / max(1, len(text.replace(" ", "")))
    if links > LINKS_HIGH:
        return LINKS if block.inside else 0 if size < SHORT and links < LINKS_ALL else -1
    words = WORD.findall(text.lower())
    stops = sum(w in ALL_STOP_WORDS for w in words) / max(1, len(words))
    if size < SHORT:
        return 0
    if stops >= STOPS_HIGH:
        return 1 if size > LONG or stops >= STOPS_HIGH and links < 0.1 else 0
    if stops >= STOPS_LOW:
        return 1 if size > LONG else 0
    return 0 if block.inside or links == 0 or size > LONG and links < 0.1 else -1


def _without_named(found: list[tuple[Block, str]]) -> list[tuple[Block, str]]:
    """The blocks outside of containers left out by name, and those inside the ones that hold most of a page with neither good blocks nor an article outside."""
    outside = [x for x in found if not x[0].within]
    if len(outside) == len(found) or any(b.inside or _first_pass(b, t) > 0 for b, t in outside):
        return outside
    sizes: dict[int, int] = {}
    for b, t in found:
        for x in b.within:
            sizes[x] = sizes.get(x, 0) + len(t)
    whole = sum(len(t) for _, t in found)
    return [(b, t) for b, t in found if all(2 * sizes[x] > whole for x in b.within)]


def main_text(page: str | None) -> str:
    """The main text: blocks joined by one space, white space inside a block turned into one space."""
    if not page:
        return ""
    found = [(b, " ".join("".join(b.parts).split())) for b in blocks(page)]
    found = _without_named([(b, t) for b, t in found if t])
    has_article = any(b.inside for b, _ in found)
    first = [_first_pass(b, t) for b, t in found]
    labels = list(first)
    for side in (True, False):
        mine = [i for i, (b, _) in enumerate(found) if b.inside == side and first[i] != LINKS]
        edge = 1 if side else -1
        before, after = {}, {}
        for order, near in ((mine, before), (mine[::-1], after)):
            last, gap = edge, 1 << 60
            for i in order:
                near[i] = (last, gap)
                if first[i]:
                    last, gap = first[i], 0
                gap += len(found[i][1])
        for i in mine:
            if first[i] == 0:
                (a, da), (b, db) = before[i], after[i]
                if has_article:
                    labels[i] = max(a, b) if side else min(a, b)
                else:
                    labels[i] = a if a == b or da <= db else b
    texts = [i for i, (b, _) in enumerate(found) if b.inside and first[i] != LINKS]
    for i, x in enumerate(first):
        if x == LINKS:
            k = bisect_left(texts, i)
            labels[i] = 1 if 0 < k < len(texts) and labels[texts[k - 1]] > 0 and labels[texts[k]] > 0 else -1
    if all(x < 0 for x in labels) and not has_article:  # no block decided the page: what isn't links is all there is
        labels = [1 if x == 0 else -1 for x in first]
    return " ".join(t for (_, t), x in zip(found, labels, strict=True) if x > 0)


def extract_main_text(pages: DataFrame, *, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """Adds the main text of each page (empty for null or empty html). Other columns are kept; out_col, in any case, is replaced.

    Broken markup, unclosed elements and very long pages are read in one pass; repeated rows stay. Of decided neighbours that are
    equally near and differ, the one before decides.
    """
    kept = [c for c in pages.columns if c.lower() != out_col.lower()]

    @F.pandas_udf("string")
    def extract(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in it:
            yield pages.map(main_text, na_action=None)

    return text_batches(pages).select(*[F.col(f"`{c}`") for c in kept], extract(F.col(html_col)).alias(out_col))
