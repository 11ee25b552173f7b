"""Links between articles and other tables: entities, catalogs, source profiles, regions and favourites by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import normalize, text, tokens
from newsloom.operators.relational import first_of, nearest, phrase_join

# Club words, and weights of favourites.
CLUB_WORDS = ["aif", "ais", "bk", "bois", "fc", "ff", "fk", "gif", "hc", "hf", "hif", "if", "ifk", "ik", "lf", "maif", "sk"]
TYPE_PRIORITY = {"player": 300, "team": 200, "staff": 150, "league": 100}
MOST_FAVORITES = 5


def item_entities(links: DataFrame, entities: DataFrame) -> DataFrame:
    """item, entity_ids (distinct, in the order of their links), entities (struct): links to missing entities count as ids
    alone. links: item, entity_id, ordinal; entities: id and more."""
    once = first_of(links, ["item", "entity_id"], F.col("ordinal"))
    found = once.join(entities.select(F.col("id").alias("entity_id"), F.struct(*entities.columns).alias("entity")), "entity_id", "left")
    listed = found.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("ordinal", "entity_id", "entity"))).alias("all"))
    return listed.select("item", F.transform("all", lambda x: x["entity_id"]).alias("entity_ids"), F.transform(F.filter("all", lambda x: x["entity"].isNotNull()), lambda x: x["entity"]).alias("entities"))


def enrich_hits(articles: DataFrame, hits: DataFrame, catalog: DataFrame) -> DataFrame:
    """hits and, for each article, the catalog's entities of its sport that title, summary or tags name, but for those
    whose type and normalised name it has already. articles: id, sport, text; hits: id, entity_id, type, name; catalog:
    entity_id, sport, type, name, aliases (array), ordinal."""
    key = F.concat_ws(":", "type", normalize(F.col("name")))
    terms = catalog.select("entity_id", "sport", "type", "name", F.col("ordinal").alias("_ordinal"), F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("term"))
    found = phrase_join(articles.select("id", "sport", "text"), terms, on=["sport"]).withColumn("_key", key)
    found = first_of(found, ["id", "_key"], F.col("_ordinal")).select("id", "entity_id", "type", "name", "_key")
    new = found.join(hits.select("id", key.alias("_key")).distinct(), ["id", "_key"], "left_anti").drop("_key")
    return hits.select("id", "entity_id", "type", "name", F.lit("linked").alias("origin")).unionByName(new.withColumn("origin", F.lit("detected")))


def new_links(inserted: DataFrame, parsed: DataFrame) -> DataFrame:
    """item, entity_id, alias, match_type: links of the rows that were new, by url. parsed: url, detected (array of struct)."""
    return inserted.select(F.col("id").alias("item"), "url").join(parsed.select("url", F.explode("detected").alias("d")), "url").select("item", "d.*")


def derived_aliases(name: Column) -> Column:
    """Of a club's name of several words: with club words the initials of the others before them, and the first other word;
    without, the initials and the first word. Lengths bound each."""
    words = tokens(normalize(name))
    club = F.array(*[F.lit(w) for w in CLUB_WORDS])
    suffix, core = F.filter(words, lambda w: F.array_contains(club, w)), F.filter(words, lambda w: ~F.array_contains(club, w))
    initials = lambda a: F.array_join(F.transform(a, lambda w: F.substring(w, 1, 1)), "")
    bounded = lambda c, low, high: F.when(F.length(c).between(low, high), c)
    code, first = F.concat(initials(core), F.array_join(suffix, "")), F.get(core, F.lit(0))
    mixed = F.array(bounded(code, 2, 8), bounded(first, 4, 1000))
    plain = F.array(bounded(initials(words), 2, 5), bounded(F.get(words, F.lit(0)), 5, 1000))
    out = F.when((F.size(suffix) > 0) & (F.size(core) > 0), mixed).otherwise(plain)
    return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(out)))


def possessives(names: Column) -> Column:
    """The possessive forms of names of four letters or more that don't end in s."""
    return F.transform(F.filter(names, lambda t: (F.length(t) >= 4) & ~F.endswith(t, F.lit("s"))), lambda t: F.concat(t, F.lit("s")))


def token_matches(title: Column, tags: Column, token: Column) -> Column:
    """The token stands in the normalised title or in a tag: several words anywhere, one word as a whole one."""
    t = normalize(token)
    within = lambda said: F.when(F.contains(t, F.lit(" ")), F.contains(said, t)).otherwise(F.contains(F.concat(F.lit(" "), said, F.lit(" ")), F.concat(F.lit(" "), t, F.lit(" "))))
    tagged = F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda g: (normalize(g) == t) | within(normalize(g)))
    return (t != "") & (within(title) | tagged)


def favorite_params(values: Column) -> Column:
    """The favourites of request parameters (an array of strings, each maybe a list with commas): without their types,
    normalised, each once, the first five."""
    split = F.flatten(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.split(text(v), ",")))
    named = F.transform(F.filter(F.transform(split, lambda v: F.trim(v)), lambda v: v != ""), lambda v: F.when(F.contains(v, F.lit(":")), F.regexp_replace(v, "^[^:]*:", "")).otherwise(v))
    return F.slice(F.array_distinct(F.filter(F.transform(named, normalize), lambda v: v != "")), 1, MOST_FAVORITES)


def token_favorites(articles: DataFrame, favorites: DataFrame) -> DataFrame:
    """item, entity_id, type, name, score: the best favourite that title or tags name. Its score is its type's priority, 50
    for the name itself and up to 25 for the name's length; equal ones go by priority, longer name and order.
    articles: item, title, tags; favorites: entity_id, type, name, tokens (array, with the name), ordinal."""
    priority = F.coalesce(F.create_map(*[F.lit(x) for kv in TYPE_PRIORITY.items() for x in kv])[F.col("type")], F.lit(0))
    terms = favorites.select("entity_id", "type", "name", F.col("ordinal").alias("_ordinal"), F.explode(F.array_distinct(F.concat(F.array("name"), "tokens"))).alias("term"))
    parts = articles.select("item", F.explode(F.concat(F.array("title"), F.coalesce("tags", F.array().cast("array<string>")))).alias("said"))
    found = phrase_join(parts, terms, text="said").withColumn("_exact", normalize(F.col("term")) == normalize(F.col("name")))
    scored = found.groupBy("item", "entity_id", "type", "name", "_ordinal").agg(F.max("_exact").alias("_exact"))
    scored = scored.withColumn("score", priority + F.when(F.col("_exact"), 50).otherwise(0) + F.least(F.length("name"), F.lit(25)))
    return first_of(scored, ["item"], F.col("score").desc(), priority.desc(), F.length("name").desc(), F.col("_ordinal")).drop("_exact", "_ordinal")


def source_profiles(sources: DataFrame, profiles: DataFrame, aliases: DataFrame, default: str | None = None) -> DataFrame:
    """source, key: of each distinct source the profile of its alias or name; else the first profile, in their order, whose
    key stands anywhere in it; else the default. profiles: key, ordinal; aliases: alias, key.

    A source is exploded into its parts of the lengths that keys have, so the search for parts is an equi-join.
    """
    low = lambda c: F.trim(F.lower(F.col(c)))
    named = sources.select("source").distinct().withColumn("_name", low("source"))
    named = named.join(aliases.select(low("alias").alias("_name"), low("key").alias("_alias")), "_name", "left").withColumn("_name", F.coalesce("_alias", "_name")).drop("_alias")
    keys = profiles.select("key", "ordinal", low("key").alias("_key")).where("_key <> ''")
    lengths = keys.agg(F.collect_set(F.length("_key")).alias("_lengths"))  # one row, as long as the longest key at most
    parts = named.join(F.broadcast(lengths)).select("source", "_name", F.explode(F.flatten(F.transform("_lengths", lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("_name") - n + 1)), lambda i: F.substring(F.col("_name"), i, n))))).alias("_key")).distinct()
    best = first_of(parts.join(keys, "_key"), ["source"], (F.col("_key") == F.col("_name")).desc(), F.col("ordinal")).select("source", "key")
    return named.select("source").join(best, "source", "left").withColumn("key", F.coalesce("key", F.lit(default)))


def regional_eligible(policy: Column, user_region: Column, favorite_ids: Column, favorite_tokens: Column, hard_news: Column) -> Column:
    """Articles of regional sources go to readers of the region, to those who follow one of the source's entities or tokens
    if the policy allows it, and to all with hard news. policy: struct of scope, region, favorite_eligible, entity_ids, tokens."""
    follows = policy["favorite_eligible"] & (F.arrays_overlap(policy["entity_ids"], favorite_ids) | F.arrays_overlap(policy["tokens"], favorite_tokens))
    regional = F.coalesce(policy["scope"] == "regional", F.lit(False))
    return ~regional | F.coalesce(policy["region"] == user_region, F.lit(False)) | F.coalesce(follows, F.lit(False)) | F.coalesce(hard_news, F.lit(False))


def team_regions(teams: DataFrame, regions: DataFrame) -> DataFrame:
    """team, region: teams that share a normalised name, alias or term with exactly one region. teams: id, name, aliases;
    regions: key, city, terms."""
    spread = lambda key, name, more, label: (F.col(key).alias(label), F.explode(F.array_distinct(F.transform(F.concat(F.array(name), F.coalesce(F.col(more), F.array().cast("array<string>"))), normalize))).alias("term"))
    t, r = teams.select(*spread("id", "name", "aliases", "team")), regions.select(*spread("key", "city", "terms", "region"))
    return t.where("term <> ''").join(r, "term").groupBy("team").agg(F.countDistinct("region").alias("_n"), F.min("region").alias("region")).where("_n = 1").drop("_n")


def region_of_city(rows: DataFrame, city: str, regions: DataFrame, aliases: DataFrame, out: str) -> DataFrame:
    """rows with the region (key) of a city name, by the regions' cities, then by aliases (alias, key); null for others."""
    keyed = rows.withColumn("_city", normalize(F.col(city)))
    known = first_of(regions.select(normalize(F.col("city")).alias("_city"), F.col("key").alias("_exact")).where("_city <> ''"), ["_city"], F.col("_exact"))
    other = aliases.select(normalize(F.col("alias")).alias("_city"), F.col("key").alias("_aliased")).where("_city <> ''").dropDuplicates(["_city"])
    return keyed.join(known, "_city", "left").join(other, "_city", "left").withColumn(out, F.coalesce("_exact", "_aliased")).drop("_city", "_exact", "_aliased")


def resolve_regions(requests: DataFrame, regions: DataFrame, aliases: DataFrame, most_km: float = 50.0) -> DataFrame:
    """requests with region and location_source: the city asked for, else the nearest region of the coordinates, else the
    city of the address, else none. requests: request, debug_city, lat, lng, ip_city; regions: key, city, lat, lng."""
    placed = requests.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select("request", "lat", "lng")
    near = nearest(placed, regions.select("key", "lat", "lng"), "request", "key", most_km).select("request", F.col("key").alias("_near"))
    out = region_of_city(region_of_city(requests, "debug_city", regions, aliases, "_debug"), "ip_city", regions, aliases, "_ip").join(near, "request", "left")
    source = F.when(F.col("_debug").isNotNull(), "debug").when(F.col("_near").isNotNull(), "coords").when(F.col("_ip").isNotNull(), "ip").otherwise("none")
    return out.withColumns({"region": F.coalesce("_debug", "_near", "_ip"), "location_source": source}).drop("_debug", "_near", "_ip")


def local_match(said: Column, terms: Column) -> Column:
    """One of a region's terms stands between word boundaries of a normalised text."""
    padded = F.concat(F.lit(" "), said, F.lit(" "))
    return F.coalesce(F.exists(terms, lambda t: (normalize(t) != "") & F.contains(padded, F.concat(F.lit(" "), normalize(t), F.lit(" ")))), F.lit(False))


def adjacency(entities: DataFrame) -> DataFrame:
    """id, teams, players: of a league its teams, of a team its players, sorted. entities: id, type, team_id, league_id."""
    of = lambda kind, key, name: entities.where(F.col("type") == kind).where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.sort_array(F.collect_set("id")).alias(name))
    joined = of("team", "league_id", "teams").join(of("player", "team_id", "players"), "id", "full")
    return joined.select("id", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("teams", "players")])


def assign_leagues(teams: DataFrame, lists: DataFrame, leagues: DataFrame) -> DataFrame:
    """teams with league_id set where a list names them; the league by its name, case doesn't count. teams: id, name,
    league_id; lists: league, team; leagues: id, name."""
    named = lists.join(leagues.select(F.lower("name").alias("_l"), F.col("id").alias("_league")), F.lower("league") == F.col("_l")).select(F.col("team").alias("name"), "_league")
    return teams.join(first_of(named, ["name"], F.col("_league")), "name", "left").withColumn("league_id", F.coalesce("_league", "league_id")).drop("_league")


def follower_lists(follows: DataFrame, entities: DataFrame) -> DataFrame:
    """device, entity_ids, names: what each device follows, distinct and sorted. follows: device, entity_id."""
    found = follows.distinct().join(entities.select(F.col("id").alias("entity_id"), "name"), "entity_id", "left")
    return found.groupBy("device").agg(F.sort_array(F.collect_set("entity_id")).alias("entity_ids"), F.sort_array(F.collect_set("name")).alias("names"))


def accept_favorites(existing: DataFrame, added: DataFrame, most: int = MOST_FAVORITES) -> DataFrame:
    """added with accepted: what is there already, and new ones while a device follows fewer than `most` of the sport.
    existing: device, sport, entity_id; added: the same and ordinal."""
    keys = ["device", "sport"]
    there = existing.select(*keys, "entity_id").distinct().withColumn("_there", F.lit(True))
    counts = existing.select(*keys, "entity_id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = added.join(there, [*keys, "entity_id"], "left").join(counts, keys, "left").withColumn("_new", F.col("_there").isNull())
    first = F.row_number().over(Window.partitionBy(*keys, "entity_id").orderBy("ordinal")) == 1
    rows = rows.withColumn("_fresh", (F.col("_new") & first).cast("int"))
    place = F.sum("_fresh").over(Window.partitionBy(*keys).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_ok", (F.col("_fresh") == 1) & (place + F.coalesce("_n", F.lit(0)) <= most))
    known = F.max("_ok").over(Window.partitionBy(*keys, "entity_id"))
    return rows.withColumn("accepted", ~F.col("_new") | known).drop("_there", "_n", "_new", "_fresh", "_ok")


def with_defaults(ranked: DataFrame, accepted: DataFrame, defaults: dict[str, object], key: str = "id") -> DataFrame:
    """ranked with the columns of accepted by id; its own columns win, and where accepted has no row, the defaults."""
    more = [c for c in accepted.columns if c != key and c not in ranked.columns]
    joined = ranked.join(accepted.select(key, *more), key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(defaults[c])) for c in more if c in defaults})


# The leagues of players who aren't abroad, the country of domestic leagues and teams, and how sure each part is.
DOMESTIC_LEAGUES, DOMESTIC_COUNTRY = ["allsvenskan", "superettan"], "sverige"
CATALOG_CONFIDENCE = {"player": 0.96, "staff": 0.97, "league": 0.94, "team": 0.93}


def core_catalog(players: DataFrame, staff: DataFrame, leagues: DataFrame, teams: DataFrame) -> DataFrame:
    """entity_id, sport, type, name, aliases, is_swedish, is_abroad_core, confidence: Swedish players, active staff abroad,
    and domestic leagues and teams, as one catalog.

    players: sport, first_name, last_name, nickname, league; staff: sport, name, aliases, active; leagues and teams: sport,
    name, country. Football players of a domestic league aren't abroad, hockey players all are. Aliases are normalised,
    each once; of leagues and teams the official name is the only one.
    """
    full = F.trim(F.concat_ws(" ", F.coalesce("first_name", F.lit("")), F.coalesce("last_name", F.lit(""))))
    home = (F.col("sport") == "football") & normalize(F.col("league")).isin(DOMESTIC_LEAGUES)
    none = F.array().cast("array<string>")

    def part(rows: DataFrame, kind: str, more: Column, abroad: Column) -> DataFrame:
        aliases = F.array_distinct(F.filter(F.transform(F.concat(F.array("name"), more), normalize), lambda a: a != ""))
        key = F.concat(F.lit("catalog-"), F.col("sport"), F.lit(f"-{kind}-"), F.replace(normalize(F.col("name")), F.lit(" "), F.lit("-")))
        return rows.select(
            key.alias("entity_id"), "sport", F.lit(kind).alias("type"), "name", aliases.alias("aliases"), F.lit(True).alias("is_swedish"), abroad.alias("is_abroad_core"),
            F.lit(CATALOG_CONFIDENCE[kind]).alias("confidence"),
        )

    domestic = lambda rows: rows.where(normalize(F.col("country")) == DOMESTIC_COUNTRY)
    parts = [
        part(players.withColumn("name", full), "player", F.array("nickname"), ~F.coalesce(home, F.lit(False))),
        part(staff.where("active"), "staff", F.coalesce("aliases", none), F.lit(True)),
        part(domestic(leagues), "league", none, F.lit(False)), part(domestic(teams), "team", none, F.lit(False)),
    ]
    return reduce(DataFrame.unionByName, parts)
