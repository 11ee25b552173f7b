"""Text functions as Column expressions: folding, normalising, titles, urls, tokens and similarities."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def compatibility(first: int, last: int) -> tuple[str, str, dict[str, str]]:
    """Of the characters in this range: those that decompose to another one (marks aside), these, and those that become several."""
    one, other, several = [], [], {}
    for k in range(first, last):
        c = chr(k)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not "\u0300" <= x <= "\u036f")
        if plain != c and len(plain) == 1:
            one.append(c)
            other.append(plain)
        elif plain != c and plain and unicodedata.category(c)[0] == "L":
            several[c] = plain
    return "".join(one), "".join(other), several


#: By rule: Latin, Greek and Cyrillic letters with marks, superscripts, letter-like signs, and full-width forms.
ACCENTED, PLAIN = (a + b + c for a, b, c in zip(compatibility(0xA0, 0x530)[:2], compatibility(0x1E00, 0x2190)[:2], compatibility(0xFF01, 0xFF5F)[:2], strict=True))
#: Letters that become several: ligatures and digraphs, and those of the presentation forms.
LIGATURES = compatibility(0xA0, 0x530)[2] | compatibility(0xFB00, 0xFB07)[2]
# Words that a title may start with and that don't belong to the story.
STORY_PREFIXES = ["just nu", "live", "klart", "officiellt", "uppgifter", "uppgift"]
DUPLICATE_PREFIXES = ["just nu", "live", "breaking", "klart", "officiellt", "official"]


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(value: Column, use) -> Column:  # noqa: ANN001
    """use(value), with the value computed once a row and not once for every element of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold(c: Column) -> Column:
    """Compatibility decomposition without combining marks, of the characters above; others stay."""
    # Each text is looked at before it is rewritten: most have nothing but ASCII, and few of the others have letters that
    # become several or marks of their own.
    out = F.translate(text(c), ACCENTED, PLAIN)
    split = out
    for letter, plain in LIGATURES.items():
        split = F.replace(split, F.lit(letter), F.lit(plain))
    bare = F.regexp_replace(split, "[\\u0300-\\u036f]", "")
    several = text(c).rlike(f"[^\\x00-\\x7f](?<=[{''.join(LIGATURES)}\\u0300-\\u036f])")
    return F.when(~text(c).rlike(r"[^\x00-\x7f]"), text(c)).when(several, bare).otherwise(out)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize(c: Column) -> Column:
    """Folded lower case, everything but letters, digits and white space as a space, collapsed."""
    return F.trim(F.regexp_replace(F.lower(fold(c)), r"[^a-z0-9\p{L}\p{N}]+", " "))


def normalize_keep(c: Column) -> Column:
    """Folded lower case and trimmed; punctuation stays. For rule patterns."""
    return F.trim(F.lower(fold(c)))


def normalize_policy(c: Column) -> Column:
    """As normalize, but apostrophes and hyphens stay. For filter policies."""
    return F.trim(F.regexp_replace(F.lower(fold(c)), r"[^a-z0-9\p{L}\p{N}'-]+", " "))


def normalize_browse(c: Column) -> Column:
    """Folded lower case, collapsed; punctuation stays. For search."""
    return collapse(F.lower(fold(c)))


def story_title(c: Column) -> Column:
    """Normalised, then without a leading story prefix."""
    return F.trim(F.regexp_replace(normalize(c), rf"^({'|'.join(STORY_PREFIXES)})\s+", ""))


def duplicate_title(c: Column) -> Column:
    """Without a leading duplicate prefix and its punctuation, then normalised."""
    stripped = F.regexp_replace(F.lower(fold(c)), rf"^\s*({'|'.join(DUPLICATE_PREFIXES)})\b\s*[:!-]*\s*", "")
    return normalize(stripped)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(fold(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def unicode_slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(fold(c)), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def seed_slug(c: Column) -> Column:
    """An ampersand is the word and; hyphens in the text stay as they are."""
    named = F.replace(F.lower(fold(F.trim(c))), F.lit("&"), F.lit(" and "))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(named, "[^a-z0-9 -]", ""), " +", "-"), "^-+|-+$", "")


def canonical_url(c: Column) -> Column:
    """Lower case, without query, fragment and closing slashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text(c))), "[?#].*$", ""), "/+$", "")


def tokens(c: Column) -> Column:
    """Words of a normalised text; an empty text has none."""
    return F.filter(F.split(c, " "), lambda x: x != "")


def contains_term(haystack: Column, term: Column) -> Column:
    """Of a normalised text: several words as a substring, one word as a whole token."""
    return F.when(F.contains(term, F.lit(" ")), F.contains(haystack, term)).otherwise(F.array_contains(tokens(haystack), term)) & (term != "")


def contains_phrase(haystack: Column, term: Column) -> Column:
    """The term between word boundaries of a normalised text."""
    return (term != "") & F.contains(F.concat(F.lit(" "), haystack, F.lit(" ")), F.concat(F.lit(" "), term, F.lit(" ")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def trigrams(c: Column, collapsed: bool = False) -> Column:
    """Distinct 3-character windows of a title padded by two spaces on each side, or by one if collapsed."""
    pad = F.lit(" " if collapsed else "  ")
    # Split once: a substring would walk to its start in every window.
    chars = F.split(F.concat(pad, c, pad), "")
    windows = lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - 3), lambda i: F.concat(F.get(x, i), F.get(x, i + 1), F.get(x, i + 2)))
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.array_distinct(let(F.filter(chars, lambda x: x != ""), windows)))


def title_similarity(a: Column, b: Column, collapsed: bool = False) -> Column:
    """The larger of the Jaccard similarities of words and of trigrams of two normalised titles."""
    return F.greatest(jaccard(F.array_distinct(tokens(a)), F.array_distinct(tokens(b))), jaccard(trigrams(a, collapsed), trigrams(b, collapsed)))


def distinct_ignoring_case(values: Column) -> Column:
    """The trimmed, non-empty strings of an array; of those equal but for case the first stays."""
    clean = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")
    ranked = F.sort_array(F.transform(clean, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("x"))))
    firsts = let(ranked, lambda r: F.filter(r, lambda x, k: (k == 0) | (F.get(r, k - 1)["low"] != x["low"])))
    return F.transform(F.sort_array(F.transform(firsts, lambda x: F.struct(x["i"], x["x"]))), lambda x: x["x"])


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * 6371 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def clamp(c: Column, low: float, high: float, fallback: float) -> Column:
    """Within bounds; null and NaN are the fallback."""
    return F.least(F.greatest(F.when(c.isNull() | F.isnan(c.cast("double")), F.lit(fallback)).otherwise(c), F.lit(low)), F.lit(high))


def clamp_int(c: Column, low: int, high: int, fallback: int) -> Column:
    number = c.cast("double")
    whole = F.when(F.isnan(number), F.lit(None)).when(number >= 0, F.floor(number)).otherwise(F.ceil(number))
    return clamp(whole, low, high, fallback).cast("long")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def is_uuid(c: Column) -> Column:
    return F.coalesce(c.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"), F.lit(False))


def time_ago(minutes: Column) -> Column:
    """A label of an age in minutes."""
    return (
        F.when(minutes < 2, F.lit("live"))
        .when(minutes < 60, F.concat(F.floor(minutes).cast("string"), F.lit(" min")))
        .otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h")))
    )


def match_score(name: Column, query: Column) -> Column:
    """Of normalised texts: 140 equal, 110 prefix, 90 contained, else null."""
    return F.when(name == query, 140).when(F.startswith(name, query), 110).when(F.contains(name, query), 90)


def round_half_up(c: Column) -> Column:
    """To the nearest integer, halves towards plus infinity."""
    return F.floor(c + 0.5)
