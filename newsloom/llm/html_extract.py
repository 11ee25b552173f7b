"""HTML extraction by equivalence-class template deduction.

A page is a list of tokens: each start or end tag with its tag path, and each text block with the path and its words.
Over the pages of one host, tokens with the same occurrence vector (how often each page has the token) form a class if
at least half of the pages, and at least `least` different ones, have them: a few copies of a page are no template. The
tokens of a valid class stand in the same order in every page and don't interleave from occurrence to occurrence; a
token that breaks the order leaves the class, and a class that interleaves is rejected. Classes are nested by position,
the most common first: each occurrence of a class must lie in one slot of another, the same in all pages, or the class is
rejected. What lies between neighbouring tokens of a class is a slot.

A text block that is itself a template token is not main text, wherever it stands. The other text is judged by its slot, over
all pages of the block (`slot_scores`): articles are long, have few links, and differ from page to page. Elements are weak
evidence beside that: whether the text stands in a main element. What boilerplate elements hold is no main text of
any slot; by class, id or role an element is one only if a whole name is (`boilerplate`), and never if it holds most of
the page's text in a main element. Pages without a template are judged by elements: what their main element holds, or all.

Pages of a host are dealt by a hash into blocks of about `block_pages`, each deducing its template by itself, so a host
can have any number of pages. A block of too few pages is one slot, judged by elements alone.

Edge cases: null html is empty and gives an empty text; pages without tags are one block; null or broken urls are one
host; repeated rows are extracted each, and count as one page in occurrence vectors; blocks of fewer than
`least` different pages have no template, and elements alone judge them; unclosed elements end with their
parent; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import materialized

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that start and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is never part of an article.
DROPPED = frozenset("script style noscript template head title nav header footer aside form button select textarea option iframe svg canvas dialog menu object".split())
#: Those that stand within a sentence; their text goes and the sentence goes on.
INLINE = frozenset("button select textarea option iframe svg canvas object".split())
#: The same by name: a class, the id or the role of an element, if its words are of these, and maybe of those below.
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo promoted promotion related recommended recommendations reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar widget".split()
)
#: Words that say nothing beside one of the above: `comments-area` is boilerplate, `has-sidebar` and `notice-period` aren't.
NEUTRAL_NAMES = frozenset("area bar block bottom box container content entry group inner item items left links list main outer page right row section site slot text top unit wrap wrapper".split())
MAIN_NAMES = frozenset("article main".split())
CLOSES = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
NAME_PARTS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


def boilerplate(names: list[str]) -> bool:
    """Whether any of an element's names says that it is boilerplate."""
    for name in names:
        words = set(NAME_PARTS.findall(name))
        if words & DROPPED_NAMES and words <= DROPPED_NAMES | NEUTRAL_NAMES:
            return True
    return False


class Block:
    """A text with what it stands in: numbers of boilerplate elements and of main elements; characters of links."""

    def __init__(self, text: str, drops: tuple[int, ...], mains: tuple[int, ...], linked: int) -> None:
        self.text, self.drops, self.mains, self.linked, self.dropped, self.main = text, drops, mains, min(linked, len(text)), bool(drops), bool(mains)


class Page(HTMLParser):
    """tokens: (key, number of the block or None)."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tokens: list[tuple[str, int | None]] = []
        self.blocks: list[Block] = []
        self.open: list[tuple[str, str, tuple[int, ...], tuple[int, ...], bool]] = []  # tag, path, boilerplate, main, in a link
        self.mains: list[tuple[int, ...]] = []  # of each main element, the boilerplate that it stands in
        self.drops = self.linked = 0
        self.parts: list[str] = []
        self.feed(html)
        self.close()
        self.flush()
        self.judge()

    def top(self) -> tuple[str, str, tuple[int, ...], tuple[int, ...], bool]:
        return self.open[-1] if self.open else ("", "", (), (), False)

    def judge(self) -> None:
        """Main elements in boilerplate count if there are no others and they hold most of the text; what holds them is none then."""
        free = {k for k, drops in enumerate(self.mains) if not drops}
        if not free and self.mains:
            held = sum(len(b.text) for b in self.blocks if b.mains)
            if 2 * held > sum(len(b.text) for b in self.blocks):
                free = set(range(len(self.mains)))
        holders = {d for k in free for d in self.mains[k]}
        for b in self.blocks:
            b.dropped, b.main = not holders.issuperset(b.drops), not free.isdisjoint(b.mains)

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        self.parts = []
        if text:
            _, path, drops, mains, _ = self.top()
            self.tokens.append((f"{path}#{text}", len(self.blocks)))
            self.blocks.append(Block(text, drops, mains, self.linked))
        self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag in ("br", "img", "wbr"):
                self.parts.append(" " if tag != "wbr" else "")
            return
        splits = tag in BLOCK or tag in DROPPED and tag not in INLINE
        if splits:
            self.flush()
            for k in range(len(self.open) - 1, -1, -1):  # elements that this one ends
                name = self.open[k][0]
                if tag in CLOSES.get(name, ()):
                    del self.open[k:]
                elif name in BLOCK:
                    break
        _, path, drops, mains, link = self.top()
        names = [n for key, value in attrs if key in ("class", "id", "role") and value for n in value.lower().split()]
        label = ".".join(sorted(f"{k}={v}" for k, v in attrs if k in ("class", "role") and v))
        named = boilerplate(names) and tag not in ("html", "body")
        if not named and (tag in MAIN_NAMES or MAIN_NAMES.intersection(names)):
            self.mains.append(drops)
            mains = (*mains, len(self.mains) - 1)
        # A page header is boilerplate, the header of an article holds its title.
        if named or tag in DROPPED and not (tag == "header" and mains):
            drops = (*drops, self.drops)
            self.drops += 1
        self.open.append((tag, f"{path}/{tag}{label and '[' + label + ']'}", drops, mains, link or tag == "a"))
        if splits:
            self.tokens.append((self.open[-1][1], None))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                if any(t in BLOCK or t in DROPPED and t not in INLINE for t, *_ in self.open[k:]):
                    self.flush()
                    self.tokens.append((f"{self.open[k][1]}/", None))
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        if self.open and (self.open[-1][0] in ("script", "style") or any(t in INLINE for t, *_ in self.open)):
            return
        self.parts.append(data)
        if self.top()[4]:
            self.linked += len(data.strip())


def in_order(order: list[str], seen: list[str]) -> list[str]:
    """The longest part of order that stands in this order in seen, which has the same tokens."""
    place = {key: k for k, key in enumerate(seen)}
    ends: list[int] = []  # of the best part of each length, the place of its last token
    last: list[str] = []
    before: dict[str, str | None] = {}
    for key in order:
        k = bisect_left(ends, place[key])
        before[key] = last[k - 1] if k else None
        ends[k : k + 1], last[k : k + 1] = [place[key]], [key]
    out, at = [], last[-1] if last else None
    while at is not None:
        out.append(at)
        at = before[at]
    return out[::-1]


def template(pages: list[Page], least: int) -> tuple[set[str], list[list[tuple]]]:
    """The keys of the tokens in the template, and of each page the slot of each token: class, gap and occurrence."""
    slots: list[list[tuple]] = [[()] * len(page.tokens) for page in pages]
    found: set[str] = set()
    if len(pages) < least:
        return found, slots
    places: dict[str, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for i, page in enumerate(pages):
        for at, (key, _) in enumerate(page.tokens):
            places[key][i].append(at)
    classes: dict[tuple, list[str]] = defaultdict(list)
    for key, at in places.items():
        if len(at) >= max(least, 0.5 * len(pages)):  # seen in enough pages to be the host's, not a page's
            classes[tuple((i, len(x)) for i, x in sorted(at.items()))].append(key)
    for vector, keys in sorted(classes.items(), key=lambda c: (-len(c[0]), sum(n for _, n in c[0]), -len(c[1]), c[1][0])):
        order: list[str] | None = None
        for i, n in vector:
            for k in range(n):
                seen = sorted(keys if order is None else order, key=lambda key: places[key][i][k])  # noqa: B023
                order = seen if order is None else in_order(order, seen)
        rounds = [(i, k, [places[key][i][k] for key in order]) for i, n in vector for k in range(n)]
        interleaved = any(a[0] == b[0] and a[2][-1] > b[2][0] for a, b in zip(rounds, rounds[1:], strict=False))
        within = [{slots[i][at] for at in held} for i, _, held in rounds]
        if interleaved or any(len(x) > 1 for x in within) or len({next(iter(x))[:2] for x in within}) > 1:
            continue
        found.update(order)
        for i, k, held in rounds:
            outer = slots[i][held[0]]
            for gap, (start, end) in enumerate(zip(held, held[1:], strict=False)):
                for at in range(start + 1, end):
                    if slots[i][at] == outer:
                        slots[i][at] = (order[0], gap, k)
    return found, slots


def slot_scores(pages: list[Page], known: set[str], slots: list[list[tuple]]) -> dict[tuple, float]:
    """The evidence that a slot holds articles, above 0 if it does, from its text on all pages.

    Half a point for each power of ten that its characters a page are over 100; up to 1 point for texts that differ, or
    against texts that are alike; up to 4 against links; and, if pages have main elements, 1.5 for text in them or against
    text outside. Boilerplate elements and template tokens don't count.
    """
    chars, linked, main = (defaultdict(int) for _ in range(3))
    said: dict[tuple, list[str]] = defaultdict(list)
    seen: dict[tuple, set[int]] = defaultdict(set)
    for i, (page, labels) in enumerate(zip(pages, slots, strict=True)):
        for (key, number), label in zip(page.tokens, labels, strict=True):
            if number is None or key in known or page.blocks[number].dropped:
                continue
            block, slot = page.blocks[number], label[:2]
            n = len(block.text)
            chars[slot] += n
            linked[slot] += block.linked
            main[slot] += n * block.main
            said[slot].append(block.text)
            seen[slot].add(i)
    share = sum(any(b.main for b in page.blocks) for page in pages) / max(1, len(pages))
    out = {}
    for slot, n in chars.items():
        distinct = len(set(said[slot])) / len(said[slot])
        out[slot] = 0.5 * math.log10(n / len(seen[slot]) / 100) + 2 * (distinct - 0.5) - 4 * linked[slot] / n + share * 3 * (main[slot] / n - 0.5)
    return out


def main_texts(pages: list[Page], known: set[str], slots: list[list[tuple]]) -> list[str]:
    """Of each page the text in the slots that hold articles; where none of it does, or without a template, by elements."""
    scores = slot_scores(pages, known, slots) if known else {}
    out = []
    for page, labels in zip(pages, slots, strict=True):
        mine = [(page.blocks[k], label[:2]) for (key, k), label in zip(page.tokens, labels, strict=True) if k is not None and key not in known and not page.blocks[k].dropped]
        chosen = [b for b, slot in mine if scores.get(slot, -1) > 0]
        if not chosen:
            # Whether a page has a main element counts, not whether it has text of its own there.
            has_main = any(b.main and not b.dropped for b in page.blocks)
            chosen = [b for b, _ in mine if b.main or not has_main]
        out.append("\n\n".join(b.text for b in chosen))
    return out


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", block_pages: int = 64, least: int = 6) -> DataFrame:
    """page_id, url, text, n_chars and template_tokens (how many of the page's tokens the template has)."""
    slim = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    # Hosts of more than a block are at most a block's share of all pages, and as a table their size is known.
    sizes = slim.groupBy(host.alias("host")).agg(F.ceil(F.count(F.lit(1)) / block_pages).alias("blocks")).where("blocks > 1")
    dealt = slim.withColumn("host", host).join(materialized(sizes), "host", "left")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("blocks", F.lit(1)))).drop("blocks")
    # A key of its own: were it host and block, a shuffle by host alone would serve, and a host would be one task.
    dealt = dealt.withColumn("deal", F.xxhash64("host", "block"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, block in group.groupby(["host", "block"]):
            each = list(dict.fromkeys(block["html"]))
            parsed = [Page(h) for h in each]
            known, slots = template(parsed, least)
            texts = dict(zip(each, main_texts(parsed, known, slots), strict=True))
            counts = {h: sum(key in known for key, _ in p.tokens) for h, p in zip(each, parsed, strict=True)}
            texts, counts = [texts[h] for h in block["html"]], [counts[h] for h in block["html"]]
            out.append(pd.DataFrame({
                "page_id": block["page_id"], "url": block["url"], "text": texts, "n_chars": [len(t) for t in texts],
                "template_tokens": counts,
            }))
        return pd.concat(out)

    schema = f"page_id {slim.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long, template_tokens long"
    return dealt.groupBy("deal").applyInPandas(run, schema)
