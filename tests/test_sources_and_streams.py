from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from newsloom.operators import relational
from newsloom.sources import feeds, tables
from newsloom.streaming import jobs

RSS = """<rss><channel><item><title><![CDATA[Isak &amp; co]]></title><link>https://a.se/1</link><pubDate>Mon, 21 Sep 2026 12:00:00 GMT</pubDate>
<category>SHL</category><category>shl</category><description>One <b>two</b> &#233;</description></item><item><title></title><link>https://a.se/2</link></item></channel></rss>"""
ATOM = """<feed><entry><title>Atom</title><link rel="self" href="https://a.se/self"/><link rel="alternate" href="https://a.se/3"/><updated>2026-09-21T12:00:00Z</updated><category term="NHL" label="nhl"/></entry></feed>"""


def test_feed_items(spark):
    got = feeds.feed_items(spark.createDataFrame([("r", RSS), ("a", ATOM), ("n", None)], "feed string, content string")).orderBy("feed").collect()
    assert [(r["feed"], r["title"], r["url"], r["tags"]) for r in got] == [("a", "Atom", "https://a.se/3", ["NHL"]), ("r", "Isak & co", "https://a.se/1", ["SHL"])]
    assert got[1]["summary"] == "One two é" and all(r["published_at"] == dt.datetime(2026, 9, 21, 12) for r in got)


def test_listing_links(spark):
    page = '<a href="/x">X</a><a href="https://b.se/y"><b>Y</b></a><a href="/x">again</a><a href="/z"></a>'
    got = feeds.listing_links(spark.createDataFrame([("https://a.se/list", page)], "url string, html string"))
    assert {(r["link"], r["title"]) for r in got.collect()} == {("https://a.se/x", "X"), ("https://b.se/y", "Y")}


def test_registry_and_seed(spark, tmp_path):
    columns = "sport string, name string, url string, type string"
    curated = spark.createDataFrame([("football", "A", "https://www.a.se/rss/", "rss"), ("football", "B", "https://bad.se/", "rss")], columns)
    found = spark.createDataFrame([("football", "A2", "http://a.se/rss", "rss"), ("football", "C", "https://c.se/rss", "scrape")], columns)
    assert [r["name"] for r in feeds.feed_registry(curated, found, ["bad.se"]).collect()] == ["A"]
    (tmp_path / "seed.csv").write_text("Sport,Type,Name,Aliases\nfootball,team,Malmö FF,MFF|mff|x\nfootball,team,Malmö FF,\n")
    got = {(r["slug"], r["alias_of"]) for r in feeds.seed_entities(spark, str(tmp_path / "seed.csv")).collect()}
    assert got == {("malmo-ff", None), ("mff", "malmo-ff")}


def test_rewrite_of_a_table(spark, tmp_path):
    name = "rewritten"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.option("path", str(tmp_path / "t")).saveAsTable(name)
    source = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, ordinal int")
    tables.rewrite(spark, name, lambda old: relational.merge_upsert(old, source, ["k"], "ordinal"))
    more = spark.createDataFrame([(3, "no", 1), (4, "d", 1)], "k int, v string, ordinal int")
    tables.rewrite(spark, name, lambda old: old.unionByName(relational.merge_insert_ignore(old, more, ["k"], "ordinal").select("k", "v")))
    tables.rewrite(spark, name, lambda old: relational.merge_delete(old, spark.createDataFrame([(1,)], "k int"), ["k"]))
    tables.rewrite(spark, name, lambda old: relational.merge_update_when(old, spark.createDataFrame([(2, "q"), (4, "q")], "k int, v string"), ["k"], "v", F.col("v") == "y"))
    assert {(r["k"], r["v"]) for r in spark.table(name).collect()} == {(2, "q"), (3, "z"), (4, "d")}
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith(f"{name}_")] == []
    spark.sql(f"DROP TABLE {name}")


def test_subscriptions(spark):
    old = spark.createDataFrame([("d", "e1", True), ("d", "e2", True), ("x", "e3", True)], "device string, endpoint string, enabled boolean")
    new = spark.createDataFrame([("d", "e2", 1)], "device string, endpoint string, ordinal int")
    got = {(r["endpoint"], r["enabled"]) for r in tables.replaced_subscriptions(old, new, "device", "endpoint", "ordinal").collect()}
    assert got == {("e1", False), ("e2", True), ("e3", True)}
    answers = spark.createDataFrame([("e1", 404), ("e2", 500), ("e3", 410), (None, 404)], "endpoint string, status int")
    assert {(r["endpoint"], r["enabled"]) for r in tables.without_gone(old, answers).collect()} == {("e1", False), ("e2", True), ("e3", False)}


def test_window_rule():
    ok, window = jobs.within_windows([0, 10, 59, 60, 61, 200], None, 60, 2)
    assert ok == [True, True, False, True, True, True] and window == (200, 1)


def test_feed_dates_of_many_forms(spark):
    values = ["Mon, 21 Sep 2026 12:00:00 GMT", "21 Sep 2026 14:00 +0200", "Monday, 21 Sep 2026 12:00:00 UT", "2026-09-21T14:00:00+02:00", "2026-09-21T14:00:00+0200", "2026-09-21T12:00:00.000Z", "2026-09-21 12:00:00", "soon", "", None]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(feeds.parse_date(F.col("v")).alias("at")).collect()
    assert [r["at"] for r in rows] == [dt.datetime(2026, 9, 21, 12)] * 7 + [None] * 3


def test_rate_rule():
    ok, history = jobs.accept_within_limits([0, 10, 20, 30, 700], [], [(600, 3), (3600, 10)])
    assert ok == [True, True, True, False, True] and history == [0, 10, 20, 700]


def test_streams(spark, tmp_path):
    rows = [(f"u{k % 3}", "d", dt.datetime(2026, 9, 21, 12) + dt.timedelta(seconds=40 * k)) for k in range(6)]
    spark.createDataFrame(rows, "url string, device string, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, device string, at timestamp").parquet(str(tmp_path / "in"))
    for name, df in (("once", jobs.once_by(stream, "url", "at")), ("rate", jobs.rate_limited(stream, "device", "at", [(600, 3)])), ("windows", jobs.window_limited(stream, "device", "at", 60, 1))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
    assert spark.sql("SELECT count(*) AS n FROM once").first()["n"] == 3
    assert spark.sql("SELECT count_if(accepted) AS n, count(*) AS m FROM rate").first() == (3, 6)
    assert spark.sql("SELECT count_if(accepted) AS n, count(*) AS m FROM windows").first() == (3, 6)
    seen = []
    jobs.each_batch(stream, lambda df, k: seen.append(df.count()), str(tmp_path / "ck")).awaitTermination(120)
    assert sum(seen) == 6
