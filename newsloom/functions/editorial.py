"""Editorial assessments of articles: which articles are worth one, which are valid, and what they grant.

An assessment is a struct of version, title, category, status, badge, breaking, evidence, assessed_at and model, made
by a model outside the engine. It counts only if it is valid for the article as it stands.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import classify
from newsloom.functions.text import normalize, text

# Version, enumerations, patterns and labels of assessments.
VERSION = 1
CATEGORIES = ["transfer", "departure", "contract", "management", "injury", "match-event", "success", "discipline", "lineup", "live", "other"]
STATUSES = ["confirmed", "reported", "rumor", "denied", "unclear"]
BADGES = [
    "HERE_WE_GO", "DONE_DEAL", "OFFICIAL", "CONFIRMED", "PRESENTED", "FIRED", "RESIGNED", "DEPARTURE", "RUMOR", "COACH", "CONTRACT", "BREAKING", "LIVE", "GOAL", "SUCCESS",
]
CANDIDATE_WORDS = (
    r"here[ _]we[ _]go|done[ _]deal|officiellt|official|confirmed|bekräftat|bekraftat|klart|klar för|klar for|klar som|presenterad|presenteras|unveil\p{L}*|får sparken|sparkar"
    r"|sparken|sacked|dismiss\p{L}*|fired|avgår|avgar|resign\p{L}*|steps down|lämnar|lamnar|depart\p{L}*|leaves|uppgifter|rykte\p{L}*|rumou?r\p{L}*|linked with|appoint\p{L}*"
    r"|takes over|tar över|tar over|ny tränare|ny tranare|new (?:head )?(?:coach|manager)|kontrakt\p{L}*|contract\p{L}*|signs|signed|signing|signerar|joins|joined|transfer\p{L}*"
    r"|värvar|varvar|förhandlar|forhandlar|live|just[ _]nu|breaking|hot|må+l\p{L}*|mal|goal\p{L}*|scores|scored|hattrick|avgör|avgor|kvitterar|nätar|natar|matchvinnare|vinstmal"
    r"|utklassning|succé\p{L}*|succe\p{L}*|red card|rött kort|rott kort|utvisning|matchstraff|silly[ _]season|ny klubb|starting xi|lineups?|startelva|laguppställning"
    r"|laguppstallning|team news"
)
LOOKING_BACK_WORDS = r"veckans|månadens|årets|ranking|rankingen|topp\s*\d+|de\s+\d+\s+bästa|tre\s+punkter|analys|krönika|hyllning|succéstarten|succestarten"
PRIORITY_CATEGORIES = ["transfer", "departure", "contract", "management", "match-event", "discipline", "live"]
VIP_CATEGORIES = ["transfer", "departure", "contract", "management", "match-event"]
#: Of each badge the label, the variant, and the categories that it goes with.
BADGE_RULES = {
    "DONE_DEAL": ("DONE DEAL", "justnu", ["transfer", "contract"]),
    "OFFICIAL": ("OFFICIELLT", "officiellt", ["transfer", "departure", "contract", "management"]),
    "CONFIRMED": ("KLART", "justnu", ["transfer", "departure", "contract", "management"]),
    "PRESENTED": ("PRESENTERAD", "officiellt", ["transfer", "management"]),
    "FIRED": ("SPARKEN", "justnu", ["management"]),
    "RESIGNED": ("AVGÅR", "justnu", ["management"]),
    "DEPARTURE": ("LÄMNAR KLUBBEN", "live", ["departure"]),
    "COACH": ("NY TRÄNARE", "officiellt", ["management"]),
    "CONTRACT": ("NYTT KONTRAKT", "officiellt", ["contract"]),
    "BREAKING": ("JUST NU", "justnu", CATEGORIES),
    "LIVE": ("LIVE", "live", ["live"]),
    "GOAL": ("MÅL", "mal", ["match-event"]),
    "SUCCESS": ("SUCCÉ", "justnu", ["success"]),
}
REPORTED_LABEL = "HERE WE GO 🚨"
EVENT_CATEGORIES = [
    ("management", r"\b(avgar|sparken|sacked|fired|appointed|appoints|new manager|new head coach|takes over|huvudtranare klar|tranarbyte)\b"),
    ("transfer", r"\b(here we go|done deal|transfer|signing|signs|signed|joins|joined|klar for|varvar|lamnar|linked with|forhandlar)\b"),
    ("injury", r"\b(injury|injured|skada|skadad|missar|out for|rehab|comeback|aterkomst)\b"),
    ("discipline", r"\b(red card|rott kort|utvisning|matchstraff|suspended|avstangd)\b"),
    ("lineup", r"\b(starting xi|lineup|lineups|startelva|laguppstallning|confirmed xi|team news)\b"),
    ("match-event", r"\b(goal|goals|score|scores|scored|mal|hattrick|assist|avgor|kvitterar|natar|winner|match winner|matchvinnare|vinstmal)\b"),
    ("live", r"\b(live|just nu|breaking)\b"),
]
MODEL_KEYS = ["badge", "breaking", "category", "evidence", "status"]
VERDICT_KEYS = ["confidence", "evidence_a", "evidence_b", "material_update", "same_event"]


#: A word's edge as the rule knows it, where letters, digits and _ of ASCII alone are word characters. So `årets` at the
#: start of a word has none before it, and doesn't look back: "Årets mål" keeps its priority.
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def joined(tags: Column) -> Column:
    return F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " ")


def candidate(title: Column, summary: Column, tags: Column) -> Column:
    """Some cue word or phrase stands by itself in title, summary or tags: worth an assessment, and no proof of anything."""
    said = F.concat(text(title), F.lit(" "), text(summary), F.lit(" "), joined(tags))
    return said.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{CANDIDATE_WORDS})(?![\p{{L}}\p{{N}}])")


def valid(a: Column, title: Column) -> Column:
    """The assessment is of this version and title, its values are known ones, and it has evidence, date and model."""
    badge = a["badge"].isNull() | a["badge"].isin(BADGES)
    dated = F.try_to_timestamp(a["assessed_at"].cast("string")).isNotNull()
    fits = (a["version"] == VERSION) & a["title"].eqNullSafe(title) & a["category"].isin(CATEGORIES) & a["status"].isin(STATUSES) & badge
    return F.coalesce(fits & a["breaking"].isNotNull() & (F.trim(a["evidence"]) != "") & dated & (a["model"] != ""), F.lit(False))


def exceptional_success(title: Column) -> Column:
    """No retrospective, ranking or commentary."""
    return ~F.lower(text(title)).rlike(f"(?iu){EDGE}(?:{LOOKING_BACK_WORDS}){EDGE}")


def priority(a: Column, title: Column) -> Column:
    """The assessment grants editorial priority. a: a valid assessment or null."""
    here = (a["status"] == "reported") & a["badge"].eqNullSafe(F.lit("HERE_WE_GO")) & (a["category"] == "transfer")
    grants = a["breaking"] | a["category"].isin(PRIORITY_CATEGORIES) | ((a["category"] == "success") & exceptional_success(title))
    return F.coalesce(here | ((a["status"] == "confirmed") & grants), F.lit(False))


def vip(a: Column, title: Column) -> Column:
    grants = a["breaking"] | a["category"].isin(VIP_CATEGORIES) | ((a["category"] == "success") & exceptional_success(title))
    return priority(a, title) & F.coalesce((a["status"] == "confirmed") & grants, F.lit(False))


def urgency(a: Column, title: Column) -> Column:
    return F.when(priority(a, title), 12).otherwise(0)


def badge(a: Column, title: Column) -> Column:
    """struct(label, variant), or null. Rumors, denied and unclear claims have none."""
    made = lambda label, variant: F.struct(F.lit(label).alias("label"), F.lit(variant).alias("variant"))
    shown = (a["status"] == "confirmed") & ~((a["category"] == "success") & ~exceptional_success(title))
    out = F.when((a["badge"] == "HERE_WE_GO") & a["status"].isin("confirmed", "reported") & (a["category"] == "transfer"), made(REPORTED_LABEL, "justnu"))
    for name, (label, variant, categories) in BADGE_RULES.items():
        fits = shown & (a["badge"] == name) & a["category"].isin(categories)
        out = out.when(fits & a["breaking"] if name == "BREAKING" else fits, made(label, variant))
    return out


def event_category(a: Column, title: Column, tags: Column) -> Column:
    """What an article reports: by its assessment; without one, candidates stay open; else by title and tags."""
    by_assessment = (
        F.when(a["status"].isin("denied", "unclear"), F.lit(None).cast("string")).when(a["category"].isin("departure", "contract"), "transfer").when(a["category"] != "other", a["category"])
    )
    said = normalize(F.concat(text(title), F.lit(" "), joined(tags)))
    return F.when(a.isNotNull(), by_assessment).when(~candidate(title, F.lit(""), tags), classify.first_rule(said, EVENT_CATEGORIES))


def json_kind(answer: Column, key: str) -> Column:
    """What a key of a JSON object holds: BOOLEAN, STRING, a number's type; null for what is no JSON."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(answer), f"$.{key}", "variant"))


def model_result(answer: Column, title: Column, summary: Column) -> Column:
    """The assessment fields of a model's JSON answer, or null if it isn't exactly what was asked for: these keys, known
    values, and evidence of 4 to 400 characters that stands literally in title or summary."""
    v = F.from_json(answer, "category string, status string, badge string, breaking boolean, evidence string")
    keys = F.array_sort(F.json_object_keys(answer)) == F.array(*[F.lit(k) for k in MODEL_KEYS])
    typed = (json_kind(answer, "breaking") == "BOOLEAN") & (json_kind(answer, "evidence") == "STRING")
    evidence = (F.length(F.trim(v["evidence"])) >= 4) & (F.length(v["evidence"]) <= 400) & (F.contains(text(title), v["evidence"]) | F.contains(text(summary), v["evidence"]))
    fits = keys & v["category"].isin(CATEGORIES) & v["status"].isin(STATUSES) & (v["badge"].isNull() | v["badge"].isin(BADGES)) & typed & evidence
    return F.when(F.coalesce(fits, F.lit(False)), v)


def story_verdict(answer: Column, title_a: Column, title_b: Column) -> Column:
    """struct(same_event, material_update, confidence, confirmed) of a model's JSON comparison of two titles, or null.
    Evidence of 4 to 160 characters must stand in each title; confirmed: the same event, no update, confidence 0.9 or more."""
    v = F.from_json(answer, "same_event boolean, material_update boolean, confidence double, evidence_a string, evidence_b string")
    keys = F.array_sort(F.json_object_keys(answer)) == F.array(*[F.lit(k) for k in VERDICT_KEYS])
    shown = lambda e, t: F.length(e).between(4, 160) & F.contains(text(t), e)
    typed = (json_kind(answer, "same_event") == "BOOLEAN") & (json_kind(answer, "material_update") == "BOOLEAN") & (json_kind(answer, "confidence") != "STRING")
    fits = keys & typed & v["same_event"].isNotNull() & v["material_update"].isNotNull() & v["confidence"].between(0, 1) & shown(v["evidence_a"], title_a) & shown(v["evidence_b"], title_b)
    confirmed = v["same_event"] & ~v["material_update"] & (v["confidence"] >= 0.9)
    return F.when(F.coalesce(fits, F.lit(False)), F.struct(v["same_event"], v["material_update"], v["confidence"], confirmed.alias("confirmed")))


def canonical_event(a: Column, title: Column, tags: Column) -> Column:
    """The event of a title for duplicate checks: by its assessment; candidates without one have none; else by its words."""
    by_assessment = (
        F.when(a["status"].isin("denied", "unclear") | (a["category"] == "other"), F.lit(None).cast("string"))
        .when(a["category"] == "match-event", "goal").when(a["category"].isin("departure", "contract"), "transfer").otherwise(a["category"])
    )
    return F.when(a.isNotNull(), by_assessment).when(~candidate(title, F.lit(""), tags), classify.canonical_event(normalize(title)))


def event_key(a: Column, title: Column, tags: Column, published_at: Column) -> Column:
    """person|event|day, null without a person."""
    person = classify.person_key(normalize(title))
    day = F.coalesce(F.date_format(published_at, "yyyy-MM-dd"), F.lit("unknown"))
    return F.when(person.isNotNull(), F.concat_ws("|", person, F.coalesce(canonical_event(a, title, tags), F.lit("unknown")), day))
