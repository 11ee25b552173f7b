"""Stories batch by batch, and feed documents as a data source."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.operators import incremental, stories
from newsloom.sources import feed_source
from newsloom.streaming import jobs

START = datetime(2024, 1, 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_of_pairs_gives_the_same_labels(spark, tmp_path, seed):
    rng = random.Random(seed)
    times = spark.createDataFrame([(i, START + timedelta(minutes=rng.randrange(300))) for i in range(60)], "item long, published_at timestamp").cache()
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)]
    pairs = [p for p in pairs if p[0] != p[1]]
    frame = lambda some: spark.createDataFrame(some, "a long, b long")
    want = {r["item"]: r["story"] for r in stories.link_stories(frame(pairs), times.withColumnRenamed("item", "id")).collect()}
    for k, cuts in enumerate(([], [12, 20, 28])):
        store = incremental.StoryLabels(spark, f"{tmp_path}/labels{k}")
        before: dict = {}
        for n, (low, high) in enumerate(zip([0, *cuts], [*cuts, len(pairs)], strict=True)):
            changed = {r["item"]: r["story"] for r in store.merge(frame(pairs[low:high]), times, n).collect()}
            now = {r["item"]: r["story"] for r in store.labels().collect()}
            # Only what is new or has another label is written.
            assert changed == {i: s for i, s in now.items() if before.get(i) != s}
            before = now
        assert before == want
        # The last batch again changes nothing.
        store.merge(frame(pairs[cuts[-1] if cuts else 0 :]), times, len(cuts))
        assert {r["item"]: r["story"] for r in store.labels().collect()} == want
    assert incremental.StoryLabels(spark, f"{tmp_path}/none").labels().count() == 0


def test_articles_of_a_stream_are_linked_to_recent_ones(spark, tmp_path):
    schema = "id long, sport string, title string, published_at timestamp, entity_ids array<long>, ordinal long"
    row = lambda i, m, title, e: (i, "football", title, START + timedelta(minutes=m), [e], i)
    batches = [[row(1, 0, "Isak klar för Liverpool", 7), row(2, 10, "AIK vann derbyt", 8)], [row(3, 60, "Liverpool: Isak är klar", 7)], [row(4, 900, "Isak klar för Liverpool", 7), row(5, 905, "Klar: Isak till Liverpool", 7)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stored = lambda: spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    store = incremental.StoryLabels(spark, f"{tmp_path}/labels")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    handle = incremental.link_batches(store, stored, lambda c: c.where(F.col("similarity") >= 0.3))
    jobs.each_batch(stream, handle, f"{tmp_path}/checkpoint").awaitTermination()
    assert {r["item"]: r["story"] for r in store.labels().collect()} == {1: 1, 3: 1, 4: 4, 5: 4}


RSS = "<rss><channel><item><title>{}</title><link>https://x.org/{}</link></item></channel></rss>"


def test_feed_documents_batch_and_stream(spark, tmp_path):
    folder = tmp_path / "landing"
    (folder / "deep").mkdir(parents=True)
    (folder / "one.xml").write_text(RSS.format("Ett", 1))
    (folder / "deep" / "b.xml").write_bytes(f'<?xml version="1.0" encoding="iso-8859-1"?>{RSS.format("Mål", 2)}'.encode("latin-1"))
    (folder / "bad.xml").write_bytes(b"<rss><item><title>\xff\xfe\xfa</title></item></rss>")
    (folder / "empty.xml").write_text("")
    (folder / "page.xml").write_text("<html>no feed</html>")
    (folder / "_hidden").write_text("x")
    feed_source.register(spark)
    for size in (1, 16 << 20):
        docs = spark.read.format("feed_documents").option("partitionBytes", size).load(str(folder))
        items, broken = feed_source.items_of(docs)
        assert sorted((r["feed"], r["title"], r["url"]) for r in items.collect()) == [("deep", "Mål", "https://x.org/2"), ("one", "Ett", "https://x.org/1")]
        assert sorted((r["feed"], r["error"]) for r in broken.collect()) == [("bad", "not utf-8-sig: UnicodeDecodeError"), ("empty", "empty"), ("page", "no item")]
    assert docs.rdd.getNumPartitions() == 1
    out = tmp_path / "out"

    def run():
        items, _ = feed_source.items_of(spark.readStream.format("feed_documents").load(str(folder)))
        items.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").trigger(once=True).start(str(out)).awaitTermination()
        return sorted(r["title"] for r in spark.read.parquet(str(out)).collect())

    assert run() == ["Ett", "Mål"]
    (folder / "two.xml").write_text(RSS.format("Två", 3))
    assert run() == ["Ett", "Mål", "Två"]
    assert run() == ["Ett", "Mål", "Två"]
    with pytest.raises(Exception, match="needs a folder"):
        spark.read.format("feed_documents").load().collect()
