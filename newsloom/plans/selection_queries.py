"""Registered queries of selections, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import rank, selection
from newsloom.plans.news_queries import CANDIDATE_SQL, NEWS, news, pick, pick_sql
from newsloom.plans.registry import now, query, table

KINDS = ["league", "team", "player", "coach", "staff"]


@query(
    "WITH h AS (SELECT c_custkey, i, " + pick_sql(KINDS, "c_custkey // 3 + i * 2") + """ AS kind, (c_custkey + i) % 2 = 0 AS swedish, ((c_custkey * 7 + i * 3) % 5)::DOUBLE AS confidence FROM customer, (SELECT unnest([0, 1, 2, 3]) AS i)),
 w AS (SELECT *, CASE kind WHEN 'player' THEN 4 WHEN 'team' THEN 2 ELSE 3 END AS weight FROM h WHERE kind <> 'league')
 SELECT c_custkey, i AS anchor FROM customer LEFT JOIN (SELECT c_custkey, i FROM w QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY weight DESC, swedish DESC, confidence DESC, i) = 1) USING (c_custkey)"""
)
def k12_anchor_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    hits = F.array(*[F.struct(F.lit(i).alias("i"), pick(KINDS, F.floor(k / 3) + i * 2).alias("type"), ((k + i) % 2 == 0).alias("is_swedish"), ((k * 7 + i * 3) % 5).cast("double").alias("confidence")) for i in range(4)])
    return table(spark, sf_dir, "customer").select("c_custkey", selection.anchor_entity(hits)["i"].alias("anchor"))


@query(
    """WITH a AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events WHERE event_type = 'click' QUALIFY position <= 5), b AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events WHERE event_type = 'view')
 SELECT user_id, event_id, place AS position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY part, position) AS place FROM (SELECT *, 0 AS part FROM a UNION ALL SELECT *, 1 FROM b)) WHERE place <= 12"""
)
def k14_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    first = rank.top_k(e.where("event_type = 'click'"), ["user_id"], 5, F.col("ts"), F.col("event_id"))
    more = rank.ordered(e.where("event_type = 'view'"), ["user_id"], F.col("ts"), F.col("event_id"))
    return selection.fill(first, more, ["user_id"], 12).select("user_id", "event_id", F.col("position").cast("long").alias("position"))


@query(
    NEWS + " SELECT doc_id AS id FROM (SELECT * FROM news WHERE doc_id % 7 <> 0 AND published_at BETWEEN TIMESTAMP '2024-01-07 21:00:00' AND TIMESTAMP '2024-01-08' AND published_at + to_minutes(20) <= TIMESTAMP '2024-01-08' ORDER BY published_at DESC, doc_id LIMIT 250) WHERE "
    + CANDIDATE_SQL.format("title || '  ' || array_to_string(tags, ' ')") + " ORDER BY published_at DESC, doc_id LIMIT 3"
)
def m08_backfill_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = news(spark, sf_dir).withColumns({"id": F.col("doc_id"), "assessed": F.col("doc_id") % 7 == 0, "fetched_at": F.col("published_at") + F.expr("INTERVAL 20 MINUTES")})
    return selection.backfill_candidates(rows, now()).select("id")


@query(
    """WITH r AS (SELECT event_id, user_id, event_type, event_id % 7 AS e, event_id % 11 AS l, ts FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, e ORDER BY ts DESC, event_id DESC) AS a, row_number() OVER (PARTITION BY user_id, event_type, l ORDER BY ts DESC, event_id DESC) AS b FROM r)
 SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS position FROM k WHERE a = 1 AND b = 1 QUALIFY position <= 20"""
)
def u11_recent_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("type"), (k % 7).alias("entity_id"), F.concat(F.lit("Label "), (k % 11).cast("string")).alias("label"), F.col("ts").alias("at"), k.alias("ordinal"))
    return selection.recent_choices(e, ["user_id"]).select("user_id", "event_id", F.col("position").cast("long").alias("position"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'seed' END AS name FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def j29_seed_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return selection.with_fallback_rows(c, c.where("id % 2 = 0"), c.where("id % 3 = 0").withColumn("name", F.lit("seed")), "id")


@query("SELECT o_orderkey AS item, o_custkey AS device, c_name AS title FROM orders LEFT JOIN customer ON c_custkey = o_orderkey AND c_custkey % 2 = 0")
def j26_x44_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("device"), F.col("o_orderkey").alias("entity_id"))
    articles = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit("s").alias("source"), F.lit(None).cast("timestamp").alias("published_at"))
    return selection.audited(selection.engine_favorites(o), articles).select("item", "device", "title")
