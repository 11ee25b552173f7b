"""Benchmark decontamination by template canonicalisation.

Words lose their punctuation and case; numbers, units and names become typed placeholders, so a question with other
numbers has the same template. Windows of `width` template tokens are hash-joined between documents and benchmark
items. In one alignment of the two, slots are consistent if equal values of the item stand for equal values in the
document. Inserted or lost words shift the rest of a passage, so alignments that lie at most half the item's windows
(or `width`, if more) apart are counted together if their slots are consistent in all; alignments further apart are other places of
the document and never add up. A document holds an item if at least `share` of the item's windows are joined at one
place; of an alignment that isn't consistent, the windows count whose values are the item's own.

A placeholder's value is kept beside it. Windows made of placeholders alone carry no question and don't count.

The benchmark's window hashes are sent to the tasks only if there are at most `max_broadcast`; the windows that can't
join then leave before the shuffle. With more, all windows are shuffled. The result is the same.

Edge cases: null texts have no tokens; items and documents shorter than a window never match, but items of fewer tokens
than `width` are matched whole, with windows of their own length; items without tokens match nothing; repeated items
are each found; repeated rows of one document id and text are one document, rows of one id with other texts and of null ids are
documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import bound_batches, materialized

NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th)?(%|[a-z]{1,4})?", re.I)
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb oz ml cl l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years % percent euro euros dollar dollars cent cents usd eur gbp meter meters metre metres kilometer kilometers kilometre kilometres mile miles gram grams kilogram kilograms liter liters litre litres inch inches foot feet pound pounds ounce ounces degree degrees watt watts volt volts joule joules".split()
)
EDGE = "\"'`.,;:!?()[]{}<>«»“”‘’…-–—*#$&|_~%"
WORD, NUM, UNIT, NAME, CAPITAL = range(5)
PLACEHOLDER = {NUM: "\x01num", UNIT: "\x01unit", NAME: "\x01name"}
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def hashed(token: str) -> int:
    return xxhash.xxh64_intdigest(token)


class Tokens(dict):
    """What a raw word is: (hash of its token, kind, ends a sentence), filled on demand and bounded."""

    def __missing__(self, raw: str) -> tuple[int, int, bool]:
        if len(self) > 300_000:
            self.clear()
        plain = raw.strip(EDGE)
        low = plain.lower()
        ends = raw.rstrip("\"'`)]}»”’*#$&|_~%")[-1:] in (".", "!", "?", ":")
        if not plain:
            kind, token = (UNIT, PLACEHOLDER[UNIT]) if raw == "%" else (-1, "")
        elif NUMBER.fullmatch(plain):
            kind, token = NUM, PLACEHOLDER[NUM]
        elif low in UNITS:
            kind, token = UNIT, PLACEHOLDER[UNIT]
        else:
            kind, token = (CAPITAL if plain[0].isupper() and plain[1:] == plain[1:].lower() else WORD), low
        self[raw] = found = (hashed(token), kind, ends)
        return found


NAME_HASH = np.uint64(hashed(PLACEHOLDER[NAME]))


def canonical(text: str | None, known: Tokens) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Hashes and kinds of the template tokens of a text, and its raw words. A capital inside a sentence is a name."""
    raw = text.split() if isinstance(text, str) else []
    if not raw:
        return np.empty(0, np.uint64), np.empty(0, np.int8), raw
    h, kind, ends = zip(*map(known.__getitem__, raw), strict=True)
    h, kind, ends = np.array(h, np.uint64), np.array(kind, np.int8), np.array(ends)
    name = kind == CAPITAL
    name[0] = False
    name[1:] &= ~ends[:-1]
    kind[kind == CAPITAL] = WORD
    kind[name], h[name] = NAME, NAME_HASH
    there = kind >= 0
    if not there.all():
        h, kind, raw = h[there], kind[there], [w for w, x in zip(raw, there, strict=True) if x]
    return h, kind, raw


def windows(h: np.ndarray, kind: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of this width with at least one word."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    out, some = np.zeros(n, np.uint64), np.zeros(n, bool)
    for j in range(width):
        out = out * BASE + h[j : j + n]
        some |= kind[j : j + n] == WORD
    out ^= out >> np.uint64(29)
    out = out * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(width)
    at = np.flatnonzero(some)
    return at, out[at]


def value_of(raw: str) -> str:
    return raw.strip(EDGE).lower()


def template_windows(rows: DataFrame, width: int, widths: list[int], wanted: np.ndarray | None, item: bool) -> DataFrame:
    """id, width, window, at, slots (the values of the window's placeholders, in order), windows of the text.

    item: texts of fewer tokens than width have one window of their own length; else windows of all widths are made.
    """
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, keep = Tokens(), shared.value
        for batch in batches:
            out = []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                h, kind, raw = canonical(text, known)
                for w in [min(width, len(h))] if item else widths:
                    if not w:
                        continue
                    at, window = windows(h, kind, w)
                    total = len(at)
                    if keep is not None and total:
                        near = np.searchsorted(keep, window)
                        hit = keep[np.minimum(near, len(keep) - 1)] == window
                        at, window = at[hit], window[hit]
                    for a, x in zip(at.tolist(), window.view(np.int64).tolist(), strict=True):
                        slots = [value_of(raw[a + j]) for j in range(w) if kind[a + j] != WORD]
                        out.append((key, w, x, a, slots, total))
            yield pd.DataFrame(out, columns=["id", "width", "window", "at", "slots", "windows"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, width int, window long, at long, slots array<string>, windows long")


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    width: int = 5, share: float = 0.8, max_broadcast: int = 2_000_000,
) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched and n_exact (slot values are the item's own): the items held by a document.

    The benchmark's windows are written in the shared folder while the plan is built.
    """
    held = _held(docs, benchmark, doc_id, text, item_id, item_text, width, share, max_broadcast)
    kind = docs.select(F.col(doc_id)).schema[0].dataType
    own = F.when(F.startswith("key", F.lit("v")), F.regexp_extract("key", r"(?s)^v(.*):-?\d+$", 1)).cast(kind)
    return held.select(own.alias("doc_id"), "item_id", "n_windows", "n_matched", "n_exact")


def _key(doc_id: Column, text: Column) -> Column:
    """A document: its id, or that it has none, and its text's hash."""
    return F.concat(F.coalesce(F.concat(F.lit("v"), doc_id.cast("string")), F.lit("n")), F.lit(":"), F.xxhash64(text).cast("string"))


def _held(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, width: int, share: float, max_broadcast: int) -> DataFrame:
    bound_batches(docs.sparkSession)
    items = benchmark.select(F.col(item_id).alias("id"), F.col(item_text).alias("text"))
    made = template_windows(items, width, [width], None, True)
    made = materialized(made.select(
        F.col("id").alias("item_id"), "width", "window", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), F.col("windows").alias("n_windows")
    ))
    widths = sorted(r["width"] for r in made.select("width").distinct().collect())  # at most `width` values
    wanted = None
    if made.count() <= max_broadcast:
        wanted = np.unique(np.array([r["window"] for r in made.select("window").distinct().collect()], np.int64).view(np.uint64))
        if not len(wanted):
            wanted = np.zeros(1, np.uint64)
    slim = docs.select(_key(F.col(doc_id), F.col(text)).alias("id"), F.col(text).alias("text"))
    found = template_windows(slim, width, widths, wanted, False).drop("windows").withColumnRenamed("id", "key")
    joined = found.join(made, ["width", "window"])
    same = F.col("item_slots") == F.col("slots")
    pairs = F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("item"), b.alias("doc")))
    # An alignment holds at most the item's windows.
    aligned = joined.withColumn("shift", F.col("at") - F.col("item_at")).groupBy("key", "item_id", "shift", "n_windows").agg(
        F.collect_set("item_at").alias("places"),
        F.collect_set(F.when(same, F.col("item_at"))).alias("same"),
        F.array_distinct(F.flatten(F.collect_list(pairs))).alias("pairs"),
    )
    functional = lambda pairs: F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda x: x["item"])))
    consistent = functional(F.col("pairs"))
    # Two rows of tiles that overlap by half: alignments within half a tile are in one tile together.
    tile = F.greatest(F.col("n_windows"), F.lit(2 * width))
    tiles = F.array(F.floor(F.col("shift") / tile) * 2, F.floor((F.col("shift") + tile / 2) / tile) * 2 + 1)
    placed = aligned.withColumn("fits", consistent).withColumn("tile", F.explode(F.array_distinct(tiles)))
    union = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    places = placed.groupBy("key", "item_id", "n_windows", "tile").agg(
        union(F.when(F.col("fits"), F.col("places")).otherwise(F.col("same"))).alias("all"), union(F.col("same")).alias("same"),
        union(F.when(F.col("fits"), F.col("pairs"))).alias("pairs"), F.max(F.when(F.col("fits"), F.size("places")).otherwise(0)).alias("best"),
    )
    # Alignments that contradict each other don't add up: the best of them counts, or what is the item's own.
    matched = F.when(functional(F.col("pairs")), F.size("all")).otherwise(F.greatest("best", F.size("same"))).cast("long")
    out = places.groupBy("key", "item_id", "n_windows").agg(F.max(matched).alias("n_matched"), F.max(F.size("same").cast("long")).alias("n_exact"))
    return out.where(F.col("n_matched") >= F.col("n_windows") * share)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    width: int = 5, share: float = 0.8, max_broadcast: int = 2_000_000,
) -> DataFrame:
    """docs without those that hold an item; all columns."""
    held = _held(docs, benchmark, doc_id, text, item_id, item_text, width, share, max_broadcast).select(F.col("key").alias("_held")).distinct()
    return docs.join(held, _key(docs[doc_id], docs[text]) == F.col("_held"), "left_anti")
