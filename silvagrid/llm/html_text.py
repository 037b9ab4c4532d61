"""Main text of web pages by two-pass block rules.

A page is read once into blocks: stretches of text between block-level tags. Blocks in places that never hold
the article (navigation, page headers and footers, sidebars, forms, comments, adverts, notices; by element, by
role, or by a word of class or id) go at once, as do scripts and styles. The first pass decides the others by
link density, length and the density of stop words (of five languages): good, bad, or undecided. In the second
pass undecided blocks take the label of their nearest decided neighbours. Inside ``article`` or ``main`` only
link density decides against a block that doesn't read like a sentence, neighbours outside don't count, and where nothing is decided the block is
kept; elsewhere it is dropped. On a page without either, a block with decided neighbours on one side only takes
their label, a block with few stop words is undecided at any length, and where no block has the stop words of a listed
language, length and links decide alone.

Cases: null or empty html, or a page without kept blocks, gives the empty text. Unclosed or crossed tags,
unended comments, tags and character references at the end of a page are read as far as they go. A "<" that
begins no tag is text. Repeated rows are each read; extra columns are ignored; an empty table gives an empty
result. White space is what str.split() takes for it, so a no-break space counts.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from silvagrid.llm.common import slices, table

_RAW = "script style noscript template textarea svg math iframe object select canvas video audio title"
# only behind "=" does a quote open a value in which ">" may stand
_IN_TAG = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+>?|<\?[^>]*+>?"
    rf"|<({'|'.join(_RAW.split())})(?=[\s/>]){_IN_TAG}>(?:(?<=/>)|.*?</\1\s*>|.*\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)({_IN_TAG})(?:>|\Z)"
    r"|([^<]++|<)",
    re.S | re.I,
)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
AWAY = frozenset("nav header footer aside form menu dialog button fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words of class and id that mark a place outside the article.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar side aside widget widgets"
    " footer header masthead topbar toolbar comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription"
    " signup login share sharing social related recommended pagination pager tags skip".split()
)
VOID = frozenset("br img hr input meta link area base col embed source track wbr param".split())
#: A class with one of these words says what its place has or lacks, not what it is.
STATES = frozenset("no not has have is with without hide hidden show shows open closed toggle enabled disabled active".split())
_ATTR = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[^\W\d_]+")
STOP = frozenset(
    "the of and to in a is that for it was on with as be by at are this from or an he his had not which you but have they her she we were their been has will would if there can all so no"
    " der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man"
    " de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son aux ou cette mais comme on tout nous sa fait été ces"
    " el los del las una por con para su al lo como más pero sus ya este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos"
    " di che non il per si da della sono nel alla dei più anche gli ha ma o os as um uma não mais foi ao ele das tem seu sua".split()
)
_WIDE = re.compile(r"[\u2e80-\ud7ff\uf900-\ufaff\U00020000-\U0003ffff]")
SHORT, LONG, LINKS, STOP_LOW, STOP_HIGH = 70, 200, 1 / 3, 0.18, 0.28


def blocks_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, characters inside links, inside article or main) of each block that may be text of the article. An element
    whose class or id alone speaks against it is read all the same where it holds most of the page's text."""
    tokens, trusted = TOKEN.findall(page), frozenset()
    while True:
        out, held, total = _blocks(tokens, trusted)
        most = {k for k, n in held.items() if 2 * n > total}
        if not most:
            return out
        trusted |= most


def _blocks(tokens, trusted: frozenset[int]) -> tuple[list[tuple[str, int, bool]], dict[int, int], int]:
    """The blocks; the characters of text within each element put away for its class or id (by its token's number,
    the outermost only); and those of the whole page. The ``trusted`` elements' classes and ids are not asked."""
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = away = inside = links = total = 0
    stack: list[tuple[str, bool, bool]] = []
    held: dict[int, int] = {}
    by_class = -1  # the element that put this place away, if for its class or id

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text and not away:
                out.append((text, linked, inside > 0))
            parts.clear()
        linked = 0

    for number, (raw, close, name, attrs, text) in enumerate(tokens):
        if text:
            n = len(text) - text.count(" ")
            total += n
            if away and by_class >= 0:
                held[by_class] = held.get(by_class, 0) + n
            if not away:
                text = _html.unescape(text) if "&" in text else text
                parts.append(text)
                if links:
                    linked += len(text.strip())
            continue
        if not name:
            if raw:  # a script or the like stands between words at most
                parts.append(" ")
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                links = max(0, links + (-1 if close else 1)) if close or not links else links
            elif name in ("br", "img", "wbr"):
                parts.append(" " if name != "wbr" else "")
            continue
        flush()
        links = 0
        if name in VOID:
            continue
        if close:
            if any(s[0] == name for s in stack):
                while True:
                    top, off, body = stack.pop()
                    away -= off
                    inside -= body
                    if top == name:
                        break
            continue
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "html", "body", "head"):
            if name in ("html", "body", "head") or not attrs or away or number in trusted or not _hinted(attrs):
                continue  # their ends change nothing
            # a marked paragraph or list item lasts until its end tag or the next of its kind
            if stack and stack[-1][0] == name:
                _, off, body = stack.pop()
                away -= off
                inside -= body
        sure = name in AWAY and not (name == "header" and inside)
        off = sure or bool(attrs and number not in trusted and name not in ("article", "main") and _hinted(attrs))
        body = name in ("article", "main")
        if not attrs.endswith("/"):
            if off and not away:
                by_class = -1 if sure else number
            stack.append((name, off, body))
            away += off
            inside += body
    flush()
    return out, held, total


def _hinted(attrs: str) -> bool:
    for key, a, b, c in _ATTR.findall(attrs):
        for token in (a or b or c).lower().split():
            if key.lower() == "role":
                if token in ROLES:
                    return True
                continue
            words = re.split(r"[^a-z0-9]+", token)
            if STATES.isdisjoint(words) and not HINTS.isdisjoint(words):
                return True
    return False


def _dense(text: str) -> float:
    words = _WORDS.findall(text.lower())
    return sum(w in STOP for w in words) / max(1, len(words))


def main_text(page: str | None) -> str:
    found = blocks_of(page or "")
    labels: list[str] = []
    whole = not any(body for _, _, body in found)  # no article or main to go by
    density = [_dense(text) for text, _, _ in found]
    # a paragraph of an article may be one link; what reads like a sentence is none of a menu's
    density = [None if linked > LINKS * len(text) and not (body and d >= STOP_LOW) else d for d, (text, linked, body) in zip(density, found, strict=True)]
    unlisted = whole and not any(d is not None and d >= STOP_LOW and len(text) >= SHORT for d, (text, _, _) in zip(density, found, strict=True))
    for (text, _, body), dense in zip(found, density, strict=True):
        size = len(text)
        if dense is None:
            labels.append("bad")
            continue
        if unlisted:
            size += len(_WIDE.findall(text))  # an ideograph says as much as two letters or more
            labels.append("?" if size < SHORT else "good" if size > LONG else "near")
        elif size < SHORT:
            labels.append("?")
        elif dense >= STOP_HIGH:
            labels.append("good" if size > LONG or body else "near")
        elif dense >= STOP_LOW:
            labels.append("near")
        elif body or whole:
            labels.append("?")
        else:
            labels.append("bad")
    before, after = _decided(found, labels, 1), _decided(found, labels, -1)
    keep = []
    for i, (text, linked, body) in enumerate(found):
        label = labels[i]
        if label in ("?", "near"):
            around = [before[i], after[i]]
            if body:
                label = "bad" if around == ["bad", "bad"] and label == "?" and linked else "good"
            elif label == "near":
                label = "good" if "good" in around or around == [None, None] else "bad"
            elif whole:
                label = "good" if "good" in around and "bad" not in around else "bad"
            else:
                label = "good" if around == ["good", "good"] else "bad"
        if label == "good":
            keep.append(text)
    return "\n".join(keep)


def _decided(found, labels: list[str], step: int) -> list[str | None]:
    """The nearest decided label on one side of each block; inside an article, of the article's own blocks."""
    out: list[str | None] = [None] * len(found)
    last = own = None
    for i in range(len(found))[::step]:
        body = found[i][2]
        if not body:
            own = None
        out[i] = own if body else last
        if labels[i] in ("good", "bad"):
            last = labels[i]
            own = labels[i] if body else None
    return out


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column("html")):
                part = batch.slice(a, b - a)
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
