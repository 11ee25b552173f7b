"""Rule classifiers of titles and sources as Column expressions. Titles are normalised by `functions.text.normalize`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import contains_term

# Terms and patterns of the rules, accents folded.
BANNED_HOCKEY = ["bowling", "innebandy", "floorball", "curling", "skidskytte", "alpint", "skidor", "ronnby", "vallentuna b", "uppsala b", "innebandylag", "ibs", "vasterasirsta"]
JUNIOR = r"\b[uj](\d{1,2}|lag)\b|\bj-lag\b|\bjunior\b"
PERSONS = {"william nylander": "william_nylander", "nylander": "william_nylander", "viktor gyokeres": "viktor_gyokeres", "gyokeres": "viktor_gyokeres"}
TITLE_EVENTS = [
    ("missing", r"\b(saknas|saknad|saknade|franvar[oa]nde|missar|missade|utanfor\s+truppen|petad|petades)\b"),
    ("injury", r"\b(skada|skadad|skadade|skadades)\b"),
    ("training", r"\b(traning|tranar|tranade|varvar\s+upp|stegrar|rehabtranar)\b"),
    ("return", r"\b(comeback|aterkomst|tillbaka)\b"),
    ("official", r"\b(klart|officiellt|bekraftat|presenteras)\b"),
    ("transfer", r"\b(varvar|varv|transfer|kops|lamnar|lamnade|ansluter)\b"),
    ("rumor", r"\b(rykte|rykten|uppgifter|spekulation)\b"),
]
CANONICAL_EVENTS = [
    ("red_card", r"\b(red card|rott kort|utvisning|matchstraff)\b"),
    ("penalty", r"\b(straff|penalty)\b"),
    ("goal", r"\b(goal|mal|malskytt|kvitterar|equaliser|equalizer|avgor|winner|matchvinnare|hattrick|vinstmal)\b"),
    ("injury", r"\b(skada|skadad|injury|missar|out injured)\b"),
    ("transfer", r"\b(klart|officiellt|official|confirmed|done deal|here we go|signs|signerar|varvar|transfer|ny klubb)\b"),
    ("management", r"\b(sparken|sacked|dismissed|avgar|resigns|ny tranare|appoint|appointed|tar over)\b"),
    ("match_result", r"\b(vinner|vann|seger|besegrar|forlust|draw|oavgjort|wins|beats|defeats|lose|lost)\b"),
]
ANGLES = [
    ("analysis", r"\b(analys|analysis|kronika|opinion|taktik|tactical|betyg|ratings|fem punkter|five reasons|explained)\b"),
    ("followup", r"\b(reaktion|reaction|sa gick det till|bakom kulisserna|details|detaljer|intervju|interview|why|darfor)\b"),
]


def first_rule(title: Column, rules: list[tuple[str, str]]) -> Column:
    """The name of the first rule whose pattern the title has, else null."""
    out = F
    for name, pattern in rules:
        out = out.when(title.rlike(pattern), name)
    return out.otherwise(F.lit(None).cast("string"))


def title_event(title: Column) -> Column:
    return first_rule(title, TITLE_EVENTS)


def canonical_event(title: Column) -> Column:
    return F.coalesce(first_rule(title, CANONICAL_EVENTS), title_event(title))


def angle(title: Column) -> Column:
    return F.coalesce(first_rule(title, ANGLES), F.lit("news"))


def any_term(title: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for term in terms:
        out = out | contains_term(title, F.lit(term))
    return out


def banned_hockey(title: Column) -> Column:
    return any_term(title, BANNED_HOCKEY)


def junior_team(title: Column) -> Column:
    return title.rlike(JUNIOR)


def person_key(title: Column) -> Column:
    out = F
    for term, key in PERSONS.items():
        out = out.when(contains_term(title, F.lit(term)), key)
    return out.otherwise(F.lit(None).cast("string"))


def substring_any(text: Column, terms: list[str]) -> Column:
    """Any of the terms anywhere in the text, within words too. Terms that hold another one are not looked for."""
    out = F.lit(False)
    for term in dict.fromkeys(t for t in terms if not any(o != t and o in t for o in terms)):
        out = out | F.contains(text, F.lit(term))
    return out
