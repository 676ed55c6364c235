"""Main text of web pages by the maximum-scoring subsequence of words and tags.

Words add to the score of a region and tags take from it. The weights are log-odds
learnt from labelled pages: a word's depends on the element, zone and block that it stands in, a
tag's on its name. One linear scan finds the contiguous region with the highest sum; its blocks
outside boilerplate zones are the text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm import html_samples
from spendlens.llm.arrow import pieces

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|title|object|canvas|select)\b[^>]*>"
    r"|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S | re.I,
)
#: Where an element that holds no text ends, and those that without an end tag take the rest of the page.
_ENDS = {
    name: re.compile(rf"</{name}\s*>", re.I)
    for name in "script style noscript template svg iframe textarea title object canvas select".split()
}
_CODE = frozenset(("script", "style"))
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"\shidden(?=[\s=]|$)|display\s*:\s*none", re.I)
_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rb rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
AGAIN = frozenset("li p td th tr dt dd option".split())  # a new one ends one that is open
#: Elements, and words in class, id and role, that mark what is not main text.
BOILER_TAGS = frozenset("nav footer aside form head button dialog menu fieldset".split())
BOILER = frozenset(
    "ad ads advert adverts advertisement advertising aside banner breadcrumb breadcrumbs byline captcha comment "
    "comments complementary consent contentinfo cookie cookies copyright disclaimer disqus dialog feedback "
    "footer footnote form gdpr login menu menubar modal nav navbar navigation newsletter notice notification pager pagination "
    "popup promo promoted promotion recommended related reply replies respond search share sharing sidebar "
    "signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar trending widget".split()
)
WEAK = frozenset("header masthead alert warning".split())  # unless the name is also one of these:
CONTENT = frozenset("article body content entry main page post story text".split())
_KEPT_TAGS = frozenset("html body main".split())

#: Bounds of one feature's, one word's and one tag's weight, and what a tag costs at least.
FEATURE_RANGE, WORD_RANGE, TAG_RANGE, TAG_LEAST = (-3.0, 1.5), (-2.5, 2.0), -2.5, 0.02


def _is_boiler(name: str, attributes: str, in_article: bool) -> bool:
    if name in BOILER_TAGS or (name == "header" and not in_article):
        return True
    if not attributes or name in _KEPT_TAGS:
        return False
    if _HIDDEN.search(attributes):
        return True
    for _, value in _ATTRIBUTE.findall(attributes):
        for one in value.strip("\"'").split():
            words = [w.lower() for w in _NAME.findall(one)]
            if not words or words[0] in ("has", "with", "no"):
                continue
            if BOILER.intersection(words) and not (name == "article" and "post" in words):
                return True
            if not in_article and WEAK.intersection(words) and not CONTENT.intersection(words):
                return True
    return False


class _Page:
    """Tokens of a page in order: (tag name, None, left out) or ("", text, zone, linked, block tag, block number, left out).

    ``left out``: in a boilerplate zone of an open article or main element.
    """

    def __init__(self, html: str):
        self.tokens: list[tuple] = []
        stack: list[tuple[str, bool]] = []
        boiler = article = links = block = end = 0
        endless: set[str] = set()  # elements without an end tag from here on

        def leave(depth: int) -> None:
            nonlocal boiler, article, links
            for name, bad in stack[depth:]:
                boiler -= bad
                article -= name in ("article", "main")
                links -= name == "a"
            del stack[depth:]

        def say(text: str) -> None:
            if text:
                holder = next((n for n, _ in reversed(stack) if n not in INLINE), "")
                self.tokens.append(("", text, boiler > 0, links > 0, holder, block, boiler > 0 and article > 0))

        while found := _MARKUP.search(html, end):
            say(html[end : found.start()])
            end = found.end()
            raw = (found.group(1) or "").lower()
            if raw:
                block += 1
                closed = raw == "svg" and found.group().endswith("/>")
                if not closed and raw not in endless:
                    if last := _ENDS[raw].search(html, end):
                        end = last.end()
                    else:
                        endless.add(raw)
                if raw in endless and raw in _CODE:
                    end = len(html)
                continue
            closing, name, attributes = found.group(2, 3, 4)
            if name is None:
                closing, name, attributes = found.group(5, 6, 7)
            if name is None:
                continue
            name = name.lower()
            block += name not in INLINE
            self.tokens.append((name, None, boiler > 0 and article > 0))
            if closing:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == name:
                        leave(depth)
                        break
                continue
            if name in VOID:
                continue
            if name in AGAIN or name not in INLINE:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == name and name in AGAIN or stack[depth][0] == "p":
                        leave(depth)
                        break
                    if stack[depth][0] not in INLINE:
                        break
            if name == "body":
                leave(0)  # also ends a head that was not closed
            bad = _is_boiler(name, attributes, article > 0)
            if name in ("article", "main", "h1") and stack and not bad:
                # A form around the whole page is not a form to leave out.
                for depth, (outer, was_bad) in enumerate(stack):
                    if outer == "form" and was_bad:
                        stack[depth] = (outer, False)
                        boiler -= 1
            stack.append((name, bad))
            boiler += bad
            article += name in ("article", "main")
            links += name == "a"
        say(html[end:])


def _block_sizes(tokens: list[tuple]) -> Counter:
    sizes: Counter = Counter()
    for token in tokens:
        if token[1] is not None:
            sizes[token[5]] += token[1].count(" ") + 1
    return sizes


def _features(token: tuple, size: int) -> tuple[tuple, ...]:
    _, _, boiler, linked, holder, _, _ = token
    length = 0 if size < 4 else 1 if size < 10 else 2
    return (("zone", boiler), ("link", linked, length), ("holder", holder if not boiler else "-", length > 1))


class Weights:
    """Log-odds of main text, per feature of a word and per tag name."""

    def __init__(self, pages: Iterable[str] = html_samples.PAGES):
        inside, outside = Counter(), Counter()
        tags_in, tags_out = Counter(), Counter()
        for page in pages:
            main = False
            tokens = _Page(page).tokens
            sizes = _block_sizes(tokens)
            for token in tokens:
                if token[1] is None:
                    (tags_in if main else tags_out)[token[0]] += 1
                    continue
                for piece in re.split(f"([{html_samples.OPEN}{html_samples.CLOSE}])", token[1]):
                    if piece in (html_samples.OPEN, html_samples.CLOSE):
                        main = piece == html_samples.OPEN
                        continue
                    n = len(piece.split())
                    for feature in _features(token, sizes[token[5]]):
                        (inside if main else outside)[feature] += n
        self.words = {
            f: math.log((inside[f] + 1.0) / (outside[f] + 1.0)) for f in {*inside, *outside}
        }
        self.tags = {t: math.log((tags_in[t] + 1.0) / (tags_out[t] + 1.0)) for t in {*tags_in, *tags_out}}

    def word(self, features: tuple[tuple, ...]) -> float:
        low, high = FEATURE_RANGE
        total = sum(min(max(self.words.get(f, 0.0), low), high) for f in features)
        return min(max(total, WORD_RANGE[0]), WORD_RANGE[1])

    def tag(self, name: str) -> float:
        return max(min(self.tags.get(name, 0.0), -TAG_LEAST), TAG_RANGE) if name not in INLINE else -TAG_LEAST


def best_region(gains: list[float]) -> tuple[int, int]:
    """First and end of the contiguous run of the largest sum, in one scan; (0, 0) if no run gains."""
    best = total = 0.0
    start = first = last = 0
    for i, gain in enumerate(gains):
        if total <= 0:
            total, start = 0.0, i
        total += gain
        if total > best:
            best, first, last = total, start, i + 1
    return first, last


def main_text(html: str, weights: Weights) -> str:
    """The blocks of the best region, white space made one space, joined by one space."""
    tokens = _Page(html).tokens
    sizes = _block_sizes(tokens)
    words: dict[tuple, float] = {}

    def gain(token: tuple) -> float:
        if token[-1]:
            return 0.0  # not in the text anyway: an advert within the article does not cut it in two
        if token[1] is None:
            return weights.tag(token[0])
        count = len(token[1].split())
        if not count:
            return 0.0
        key = (*token[2:5], min(sizes[token[5]], 10))
        if key not in words:
            words[key] = weights.word(_features(token, sizes[token[5]]))
        return count * words[key]

    first, last = best_region([gain(token) for token in tokens])
    blocks: dict[int, list[str]] = {}
    for token in tokens[first:last]:
        if token[1] is not None and not token[2]:
            blocks.setdefault(token[5], []).append(token[1])
    found = (" ".join(unescape("".join(parts)).split()) for parts in blocks.values())
    return " ".join(text for text in found if text)


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the main text of the whole html.

    A script or style without an end tag takes the rest of the page; of other elements that hold no text only the tag goes.
    Blocks in boilerplate zones of an article neither gain nor cost. A null html is empty. No main text gives the empty string and 0; repeated rows give
    repeated results. Ids and urls pass as they are, null included.
    """
    learnt = weights or Weights()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            found = [main_text(html, learnt) for html in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()),
                 pa.array([len(x) for x in found], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    whole = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")
    )
    return whole.mapInArrow(run, "page_id long, url string, text string, n_chars long")
