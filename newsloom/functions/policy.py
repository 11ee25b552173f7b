"""Ingest and read policies as Column expressions: which articles are in scope, which sport they are of, how they rank first.

Null texts count as empty. Policies that look at normalised text take it already normalised where their name says so
(`functions.text.normalize_policy` keeps apostrophes and hyphens, `functions.text.normalize` doesn't).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.classify import substring_any
from newsloom.functions.text import let, normalize, normalize_policy, text

# Terms and patterns of the policies, as they are written before normalisation.
OTHER_SPORTS = [
    "alpint", "bandy", "bandy-vm", "basket", "biathlon", "f1", "formel 1", "friidrott", "friidrotts-vm", "golf", "handboll", "längdskidor", "orientering", "padel",
    "simning", "skidor", "skid-sm", "skid-vm", "skidskytte", "skidskytt", "slalom", "störtlopp", "tennis", "trav", "v75", "vasaloppet", "vinterstudion",
]
OTHER_SCOPE = [
    "dam-bandy", "dam-em", "dam-vm", "damallsvensk", "damallsvenskan", "damfotboll", "damhockey", "damkronorna", "damlag", "damlandslag", "damlandslaget", "damspelare",
    "damspelarna", "damserie", "damserien", "damernas", "elitettan", "flicklandslaget", "flickor", "sdhl", "u17-damer", "u19-damer", "f17", "f19",
    "women's super league", "womens super league", "women's champions league", "womens champions league", "uefa women's champions league",
    "uefa womens champions league", "wsl", "uwcl", "nwsl", "a-league women", "women", "women's", "womens", "ladies", "female",
    "frauen-bundesliga", "frauen bundesliga", "frauen", "femminile", "femenil", "femenino", "feminina", "feminine",
]
OTHER_SCOPE_WORDS = r"\b(dam|damer|kvinna|kvinnor|kvinnlig|kvinnliga|woman|women|womens|ladies|female|f17|f19|u17 damer|u19 damer)\b"
OTHER_SCOPE_STEMS = ["dam", "kvinn", "woman", "women", "ladies", "female", "f17", "f19"]
VERIFIED_NAMES = ["nova selin"]
VERIFIED_CONTEXT = r"\b(aik|fotboll|football)\b"
CLUB_SOURCES = {
    "The Stacey West": r"\b(lincoln city|the imps|weareimps)\b",
    "FeanOnline": r"\b(sc heerenveen|heerenveen|marcus linday|linday)\b",
}
CLUB_MIXED = r"\b(vrouwen|dames|vrouwenteam|meiden|vrouwenvoetbal|eredivisie vrouwen|jeugd|academy|under 1[789]|u ?1[789]|under 2[013]|u ?2[013])\b"
CLUB_COMMERCIAL = r"\b(casino|bookmaker|betting|goksite|gokken|odds|weddenschappen|advertorial|gesponsord|sponsored|affiliate|bonuscode|promocode)\b"
EXCLUDED_SPORTS = [
    "handboll", "handball", "innebandy", "floorball", "bandy", "basket", "basketball", "tennis", "padel", "volleyboll", "volleyball", "baseball", "cricket", "rugby",
    "golf", "curling", "alpint", "skidskytte", "friidrott", "athletics", "trav", "galopp", "motogp", "formel 1", "formula 1", "f1",
]
DIRECT_SIGNALS = {
    "football": [
        "fotboll", "football", "soccer", "matchday", "avspark", "kickoff", "startelva", "laguppstallning", "laguppställning", "offside", "straff", "frispark", "hörna",
        "horna", "ytterback", "mittfältare", "mittfaltare", "anfallare",
    ],
    "hockey": [
        "hockey", "ishockey", "nhl", "shl", "hockeyallsvenskan", "puck", "powerplay", "boxplay", "periodpaus", "tekning", "tekningar", "blueline", "goalie", "backcheck",
        "forecheck", "icing", "slapshot", "overtime", "sudden death",
    ],
}
LEAGUES = {
    "football": {
        "premier_league": ["premier league", "epl"], "championship": ["championship", "efl championship"], "serie_a": ["serie a"], "serie_b": ["serie b"],
        "bundesliga": ["bundesliga"], "la_liga": ["la liga"], "ligue_1": ["ligue 1"], "eredivisie": ["eredivisie"], "allsvenskan": ["allsvenskan"],
        "superettan": ["superettan"],
    },
    "hockey": {"nhl": ["nhl"], "shl": ["shl"], "hockeyallsvenskan": ["hockeyallsvenskan"]},
}
CONTENT_SIGNALS = [
    "fotboll", "football", "soccer", "allsvenskan", "superettan", "premier league", "epl", "serie a", "serie b", "bundesliga", "la liga", "ligue 1", "eredivisie",
    "ishockey", "hockey", "nhl", "shl", "hockeyallsvenskan", "startelva", "laguppställning", "laguppstallning", "avspark", "kickoff", "offside", "frispark", "hörna",
    "horna", "straff", "powerplay", "boxplay", "tekning", "tekningar", "icing", "overtime", "sudden death", "slapshot", "periodpaus", "puck",
]
DOMESTIC = [
    "shl", "allsvenskan", "superettan", "vsk", "västerås", "leksand", "djurgården", "aik", "mff", "malmö", "göteborg", "blåvitt", "brynäs", "frölunda", "färjestad", "hv71",
    "linköping", "luleå", "rögle", "skellefteå", "timrå", "växjö", "örebro", "almtuna", "björklöven", "karlskoga", "modo", "mora", "södertälje", "nybro", "oskarshamn",
    "kalmar", "östersund", "vimmerby", "löven", "vik",
]
URL_TERMS = {
    "football": ["/fotboll/", "/football/", "/allsvenskan/", "/superettan/", "/premier-league/", "/champions-league/", "/kalmar-ff/", "/kff/"],
    "hockey": ["/hockey/", "/nhl/", "/shl/", "/hockeyallsvenskan/", "/kalmar-hc/", "/nybro-vikings/", "/nybro-vikings-if/"],
}
SOURCE_TERMS = {
    "football": [
        "fotbollskanalen", "fotboll", "pressgurkan", "kalmar ff", "kff", "bollsvenskan", "barometern – kalmar ff", "olandsbladet – kalmar ff", "ölandsbladet – kalmar ff",
        "svenskafans – kalmar ff",
    ],
    "hockey": ["hockeynews", "hockeysverige", "hockey", "shl", "hockeyallsvenskan", "nhl", "kalmar hc", "nybro vikings"],
}
OTHER = {"football": "hockey", "hockey": "football"}
# Fixed value: up to so many single words are looked for one by one.
FEW = 4


def plain(term: str, keep: str = "") -> str:
    """A term as the normalisers leave it."""
    folded = "".join(c for c in unicodedata.normalize("NFKD", term) if not unicodedata.combining(c)).lower()
    return " ".join("".join(c if c.isalnum() or c in keep else " " for c in folded).split())


def contains(said: Column, term: str) -> Column:
    """Of a normalised text: several words as a substring, one word as a whole one."""
    term = plain(term)
    return F.contains(said, F.lit(term)) if " " in term else F.contains(F.concat(F.lit(" "), said, F.lit(" ")), F.lit(f" {term} "))


def contains_any(said: Column, terms: Iterable[str]) -> Column:
    """The same for many terms: a few are looked for one by one, more single words among the words of the text."""
    named = sorted({plain(t) for t in terms})
    single, several = [t for t in named if " " not in t], [t for t in named if " " in t]
    found = any_of([contains(said, t) for t in single]) if len(single) <= FEW else F.arrays_overlap(F.split(said, " "), F.array(*map(F.lit, single)))
    return found | substring_any(said, several) if several else found


def count_of(said: Column, terms: Iterable[str]) -> Column:
    """How many of the terms a normalised text has; terms that are written in two ways but equal count twice."""
    named = [plain(t) for t in terms]
    times = {n: sorted(t for t in set(named) if " " not in t and named.count(t) == n) for n in set(map(named.count, named))}
    words = F.split(said, " ")
    counts = [F.size(F.array_intersect(words, F.array(*map(F.lit, single)))) * n for n, single in times.items() if single]
    return reduce(lambda a, b: a + b, counts + [contains(said, t).cast("int") for t in named if " " in t], F.lit(0))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def detection_text(title: Column, url: Column, summary: Column, source: Column, feed: Column, tags: Column) -> Column:
    """The non-empty parts of an item, one space between them, in this order."""
    parts = F.concat(F.array(title, url, summary, source, feed), F.coalesce(tags, F.array().cast("array<string>")))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " ")


def other_scope(kept: Column) -> Column:
    """Women's and girls' sport, of a text normalised by the policy: terms anywhere, words, or a verified full name in its context."""
    names = any_of([kept.rlike(rf"(?:^|[^a-z0-9]){name.replace(' ', r'[\s-]+')}(?=$|[^a-z0-9])") for name in VERIFIED_NAMES])
    # Patterns are slow, so texts that hold none of what they need don't meet them.
    names = substring_any(kept, [name.split(" ")[-1] for name in VERIFIED_NAMES]) & names & kept.rlike(VERIFIED_CONTEXT)
    words = substring_any(kept, OTHER_SCOPE_STEMS) & kept.rlike(OTHER_SCOPE_WORDS)
    return substring_any(kept, [t.lower() for t in OTHER_SCOPE]) | words | names


def irrelevant(c: Column) -> Column:
    """Another sport anywhere in the text, within words too, or out of scope."""
    return let(normalize_policy(c), lambda kept: other_scope(kept) | substring_any(kept, [plain(t, "'-") for t in OTHER_SPORTS]))


def in_scope(title: Column, url: Column, summary: Column, tags: Column, source: Column, sport: Column) -> Column:
    """Stored rows of men's senior sport."""
    parts = F.concat(F.array(title, url, summary), F.coalesce(tags, F.array().cast("array<string>")), F.array(source, sport))
    return ~let(normalize_policy(F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " ")), other_scope)


def url_path(url: Column) -> Column:
    """Null for what isn't a url; a bare host has the path /. A missing url has the path /."""
    path = F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    return F.when(url.isNull(), "/").when(F.try_parse_url(url, F.lit("HOST")).isNotNull(), path)


def club_eligible(source: Column, title: Column, url: Column, summary: Column, tags: Column) -> Column:
    """Of the club sources only what names the club in title or path, and nothing commercial, mixed or out of scope.

    A broken url makes the result null for these sources: the caller decides whether the feed fails.
    """
    path = normalize_policy(F.regexp_replace(url_path(url), "^$", "/"))
    path = F.when(url_path(url).isNotNull(), path)
    said = F.array_join(F.transform(F.coalesce(tags, F.array().cast("array<string>")), normalize_policy), " ")
    all_of_it = F.concat(normalize_policy(title), F.lit(" "), normalize_policy(summary), F.lit(" "), said, F.lit(" "), path)
    identity = F.concat(normalize_policy(title), F.lit(" "), F.replace(path, F.lit("-"), F.lit(" ")))
    clean = ~(other_scope(all_of_it) | all_of_it.rlike(CLUB_MIXED) | all_of_it.rlike(CLUB_COMMERCIAL))
    out = F
    for name, pattern in CLUB_SOURCES.items():
        out = out.when(source == name, clean & identity.rlike(pattern))
    return out.otherwise(F.lit(True))


def verification_text(title: Column, summary: Column, tags: Column, names: Column | None = None) -> Column:
    """Normalised title, summary, tags and entity names. The source doesn't make an article one of sport."""
    join = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ")
    return normalize(F.concat_ws(" ", text(title), text(summary), join(tags), join(names) if names is not None else F.lit("")))


def has_sport_content(said: Column) -> Column:
    """Of a verification text: no excluded sport, and some content signal."""
    return (said != "") & ~contains_any(said, EXCLUDED_SPORTS) & contains_any(said, CONTENT_SIGNALS)


def league_of(said: Column, sport: Column) -> Column:
    """The first league, in order, that a verification text names, among those of the sport; null for none."""
    out = F
    for name, terms in LEAGUES["hockey"].items():
        out = out.when((sport == "hockey") & contains_any(said, terms), name)
    for name, terms in LEAGUES["football"].items():
        out = out.when((F.coalesce(sport, F.lit("")) != "hockey") & contains_any(said, terms), name)
    return out.otherwise(F.lit(None).cast("string"))


def sport_of(said: Column) -> Column:
    """The sport of a verification text: null with an excluded one; the first league's; else by direct signals."""
    out = F.when(said == "", F.lit(None).cast("string")).when(contains_any(said, EXCLUDED_SPORTS), F.lit(None).cast("string"))
    for sport in ("football", "hockey"):
        out = out.when(contains_any(said, [t for terms in LEAGUES[sport].values() for t in terms]), sport)

    def by_signals(n: Column) -> Column:
        clear = F
        for sport, other in OTHER.items():
            clear = clear.when((n[sport] > 0) & (n[other] == 0), sport)
        for sport, other in OTHER.items():
            clear = clear.when((n[sport] >= 2) & (n[sport] > n[other]), sport)
        return clear.otherwise(F.lit(None).cast("string"))

    return out.otherwise(let(F.struct(*[count_of(said, terms).alias(s) for s, terms in DIRECT_SIGNALS.items()]), by_signals))


def sport_resolution(detected: Column, verified: Column, feed_sport: Column, trusted: Column) -> Column:
    """struct(status, reason): ok, or blocked with sport_mismatch or no_sport_signal."""
    fine = F.struct(F.lit("ok").alias("status"), F.lit(None).cast("string").alias("reason"))
    blocked = lambda why: F.struct(F.lit("blocked").alias("status"), F.lit(why).alias("reason"))
    mismatch = F.coalesce(detected != feed_sport, F.lit(False))
    return F.when(mismatch, blocked("sport_mismatch")).when(detected.isNotNull() | F.coalesce(verified, F.lit(False)) | F.coalesce(trusted, F.lit(False)), fine).otherwise(blocked("no_sport_signal"))


def source_verified(required: Column, verified: Column) -> Column:
    """Sources that must be verified keep only articles with sport content."""
    return ~F.coalesce(required, F.lit(False)) | F.coalesce(verified, F.lit(False))


def sport_consistent(content: Column, detected: Column, source: Column, url: Column, sport: str, trusted: Column) -> Column:
    """Read-time guard: nothing that source or url give to the other sport; without sport content only a trusted
    source (or url) of this sport; a text of no clear sport passes. content, detected: of the verification text."""
    low = lambda c: F.trim(F.lower(text(c)))
    named = lambda s: substring_any(low(source), SOURCE_TERMS[s]) | substring_any(low(url), URL_TERMS[s])
    fallback = F.coalesce(trusted, F.lit(False)) & named(sport)
    return ~named(OTHER[sport]) & F.when(content, detected.isNull() | (detected == sport)).otherwise(fallback)


def ingest_priority(said: Column, hits: Column) -> Column:
    """100 with a player; else 80 for a domestic team, league or text, and 50 for another team or league. said: any text;
    hits: array of struct with type and name."""
    domestic = lambda c: substring_any(F.lower(text(c)), DOMESTIC)
    club = lambda h: h["type"].isin("team", "league")
    exists = lambda f: F.coalesce(F.exists(hits, f), F.lit(False))
    return (
        F.when(exists(lambda h: h["type"] == "player"), 100)
        .when(exists(lambda h: club(h) & domestic(h["name"])) | domestic(said), 80)
        .when(exists(club), 50)
        .otherwise(0)
    )
