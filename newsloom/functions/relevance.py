"""Editorial relevance of articles to readers of one country: tiers, reasons, and which linked entities the text supports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import contains_term, normalize, slug, text
from newsloom.operators.relational import phrase_join

# Reasons in their order, by the kind of term that gives them, and leagues of the country.
REASONS = [
    ("player", "swedish-player"), ("coach", "swedish-coach"), ("domestic", "swedish-domestic"), ("club", "swedish-related-club"),
    ("staff_organization", "swedish-related-staff-organization"), ("league", "swedish-related-league"), ("staff_competition", "swedish-related-staff-competition"),
]
FIRST_TIER = ["player", "coach", "domestic"]
SURNAME = 4

# Words of the second sport detector, and the pages and names of the regional paper's rule.
SECOND_HOCKEY = "shl|hockeyallsvenskan|hockeyallsv|allsvenskan hockey|ishockey|hockey|powerplay|boxplay|utvisning|period|tekning|pp|bp"
SECOND_FOOTBALL = "allsvenskan|superettan|fotboll|premier league|championship|serie a|la liga|bundesliga|eredivisie|målskytt|straff|hörna|offside|xg"
HOCKEY_ITSELF = "hockey|ishockey"
PAPER_SPORT, PAPER_CLUB = "/sport/", ["kalmar ff", "kff"]
PAPER_BLOCKED = ["/sport/resultat", "/kronikor/", "/ledare/", "/insandare/"]


def presentation(title: Column, tags: Column) -> Column:
    return normalize(F.concat(text(title), F.lit(" "), F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " ")))


def supported(hit: Column, hits: Column, said: Column) -> Column:
    """The text names the entity, or a player by a surname of four letters or more that isn't part of another player's
    full name in the text. hit, hits: structs of entity_id, type and name; said: the presentation text."""
    name = normalize(hit["name"])
    surname = F.element_at(F.split(name, " "), -1)
    owned = lambda o: (o["entity_id"] != hit["entity_id"]) & (o["type"] == "player") & F.contains(normalize(o["name"]), F.lit(" ")) & F.array_contains(F.split(normalize(o["name"]), " "), surname) & contains_term(said, normalize(o["name"]))
    by_surname = (hit["type"] == "player") & (F.length(surname) >= SURNAME) & contains_term(said, surname) & ~F.exists(hits, owned)
    return (name != "") & (contains_term(said, name) | by_surname)


def relevance(articles: DataFrame, terms: DataFrame) -> DataFrame:
    """id, tier (1: of the country, 2: related, 3: neither) and reasons. articles: id, sport, title, source, tags, hits
    (array of entity_id, type, name, is_swedish); terms: sport, kind (see REASONS), term.

    Terms are met by an equi-join, so the catalog can be of any size. Linked players who are Swedish, and teams and leagues
    that are, count if the text supports them.
    """
    said = normalize(F.concat(text(F.col("title")), F.lit(" "), text(F.col("source")), F.lit(" "), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")))
    base = articles.withColumns({"_said": said, "_shown": presentation(F.col("title"), F.col("tags"))})
    named = phrase_join(base.select("id", "sport", "_said"), terms, text="_said", on=["sport"]).groupBy("id").agg(F.collect_set("kind").alias("_kinds"))
    hits = F.coalesce("hits", F.array().cast("array<struct<entity_id:string,type:string,name:string,is_swedish:boolean>>"))
    fits = F.filter(hits, lambda h: h["is_swedish"] & supported(h, hits, F.col("_shown")))
    linked = F.array_distinct(F.array_compact(F.transform(fits, lambda h: F.when(h["type"] == "player", "player").when(h["type"].isin("team", "league"), "domestic"))))
    kinds = F.array_union(F.coalesce("_kinds", F.array().cast("array<string>")), F.coalesce(linked, F.array().cast("array<string>")))
    rows = base.join(named, "id", "left").select("id", kinds.alias("_all"))
    has = lambda k: F.array_contains("_all", k)
    reasons = F.array_compact(F.array(*[F.when(has(k), r) for k, r in REASONS]))
    first = F.arrays_overlap("_all", F.array(*[F.lit(k) for k in FIRST_TIER]))
    return rows.select("id", F.when(first, 1).when(F.size(reasons) > 0, 2).otherwise(3).alias("tier"), reasons.alias("reasons"))


def related_terms(players: DataFrame, teams: DataFrame, staff: DataFrame) -> DataFrame:
    """sport, kind, term: the clubs (with aliases) and leagues of players abroad, and organisations and competitions of
    staff abroad. players: sport, club, league, domestic; teams: sport, name, aliases; staff: sport, organization, competition."""
    away = players.where(~F.coalesce("domestic", F.lit(False)))
    clubs = away.select("sport", F.col("club").alias("name")).distinct()
    aliases = clubs.join(teams.select("sport", F.lower("name").alias("_key"), "aliases"), (F.lower(clubs["name"]) == F.col("_key")) & (clubs["sport"] == teams["sport"])).select(clubs["sport"], F.explode("aliases").alias("term"))
    part = lambda df, kind, c: df.select("sport", F.lit(kind).alias("kind"), F.col(c).alias("term"))
    out = part(clubs, "club", "name").unionByName(part(aliases, "club", "term")).unionByName(part(away, "league", "league"))
    out = out.unionByName(part(staff, "staff_organization", "organization")).unionByName(part(staff, "staff_competition", "competition"))
    return out.where(F.trim(F.coalesce("term", F.lit(""))) != "").distinct()


def second_sport(said: Column) -> Column:
    """The looser detector of the top item: hockey or football words, football if neither or both but for hockey itself."""
    hockey = said.rlike(rf"(?i)\b({SECOND_HOCKEY})\b")
    football = said.rlike(rf"(?i)\b({SECOND_FOOTBALL})\b")
    return F.when(hockey & ~football, "hockey").when(football & ~hockey, "football").when(said.rlike(rf"(?i)\b({HOCKEY_ITSELF})\b"), "hockey").otherwise("football")


def local_paper_item(title: Column, url: Column) -> Column:
    """An item of the regional paper is one of its sport pages, no results or opinion page, and names the club."""
    said = F.lower(F.concat(text(title), F.lit(" "), text(url)))
    blocked = said.rlike("|".join(PAPER_BLOCKED))
    return F.contains(said, F.lit(PAPER_SPORT)) & ~blocked & said.rlike("|".join(PAPER_CLUB))


def event_valid(event_type: Column, news_id: Column, entity_id: Column, source: Column, entity_type: Column, sport: Column) -> Column:
    """A user event has one of four types; ids and sources are bounded, entity type and sport known if given. Blank is not given."""
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    short = lambda c, n: F.coalesce(F.length(given(c)) <= n, F.lit(True))
    known = lambda c, *values: F.coalesce(given(c).isin(*values), F.lit(True))
    kind = F.coalesce(given(event_type).isin("news_impression", "news_click", "push_open", "news_dwell"), F.lit(False))
    return kind & short(news_id, 2048) & short(entity_id, 160) & short(source, 160) & known(entity_type, "player", "team", "league") & known(sport, "football", "hockey")


def trusted_favorite(matched: Column, kind: Column, context: Column, context_score: Column) -> Column:
    """The favourite score that the feed gives an article itself: by type if it matched, else 1 to 10 for its context."""
    direct = F.when(kind == "player", 18).when(kind == "team", 16).when(kind == "league", 14).otherwise(12)
    around = F.least(F.lit(10.0), F.greatest(F.lit(1.0), F.when(F.isnan(F.coalesce(context_score, F.lit(6.0))), 6.0).otherwise(F.coalesce(context_score, F.lit(6.0)))))
    return F.when(F.coalesce(matched, F.lit(False)), direct.cast("double")).when(F.coalesce(context, F.lit(False)), around).otherwise(0.0)


def fallback_entity_id(sport: Column, kind: Column, name: Column) -> Column:
    made = slug(F.trim(text(name)))
    return F.concat(sport, F.lit("-"), kind, F.lit("-"), F.when(made == "", "unknown").otherwise(made))


def label_list(value: Column) -> Column:
    """Labels of a stored string: a JSON array, or parted by the first of || | • and comma that it has; white space collapsed."""
    v = F.trim(text(value))
    parsed = F.when(F.startswith(v, F.lit("[")), F.from_json(v, "array<string>"))
    parted = F.when(F.contains(v, F.lit("||")), F.split(v, r"\|\|")).when(F.contains(v, F.lit("|")), F.split(v, r"\|")).when(F.contains(v, F.lit("•")), F.split(v, "•")).otherwise(F.split(v, ","))
    clean = F.transform(F.coalesce(parsed, parted), lambda x: F.trim(F.regexp_replace(text(x), r"\s+", " ")))
    return F.filter(clean, lambda x: x != "")


def similarity_threshold(c: Column) -> Column:
    """Between 0.5 and 0.95; what is no number stays none, and no similarity reaches it."""
    return F.when(F.isnan(c), c).otherwise(F.least(F.greatest(c, F.lit(0.5)), F.lit(0.95)))


def catalog_name(c: Column) -> Column:
    """The catalog's own normaliser: ten letters folded, other signs a space, trimmed, lower case; spaces stay as they are."""
    return F.lower(F.trim(F.regexp_replace(F.translate(c, "ÅÄÖåäöÉéÜü", "AAOaaoEeUu"), r"[^\p{L}\p{N}\s]", " ")))
