import random
import tempfile
import time

from newsloom.operators import dedupe
from newsloom.streaming.articles import first_links, weekly_counts
from newsloom.streaming.stories import Stories


def test_streams(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = [("https://www.a.example/x?utm_source=q", "2026-07-20 08:00:00", "FR"), ("https://a.example/x", "2026-07-20 09:00:00", "FR"), ("https://a.example/y", "2026-07-25 23:00:00", "FR"), ("https://a.example/z", None, "FR")]
    df = spark.createDataFrame(rows, "link string, at string, country string").selectExpr("link", "cast(at as timestamp) as date", "country")
    df.coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
    q = first_links(stream).writeStream.format("memory").queryName("links").option("checkpointLocation", f"{folder}/a").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["canonical"] for r in spark.table("links").collect()) == ["https://a.example/x", "https://a.example/y"]
    q = weekly_counts(stream).writeStream.format("memory").outputMode("complete").queryName("weeks").option("checkpointLocation", f"{folder}/b").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(str(r["week_start"]), r["n"]) for r in spark.table("weeks").collect()] == [("2026-07-19 00:00:00", 3)]


def test_stories_over_a_stream_equal_one_run(spark, tmp_path):
    rng = random.Random(12)
    words = [f"mot{chr(97 + k)}{chr(97 + k % 7)}x" for k in range(26)]
    rows = []
    for k in range(90):
        link = f"https://x.example/{rng.randint(0, 70)}" if k % 9 else f"https://y.example/{k}"
        rows.append((k, link, " ".join(rng.sample(words, 4)) if rng.random() < 0.6 else " ".join(rng.sample(words[:6], 4)), rng.choice(["FR", "DE", None]), f"2026-07-{rng.randint(1, 25):02}" if k % 5 else None))
    df = spark.createDataFrame(rows, "ord long, canonical string, title string, country string, at string").selectExpr("ord", "canonical", "title", "country", "cast(at as timestamp) as date")
    for part, (a, b) in enumerate(((0, 30), (30, 61), (61, 90))):
        df.where(f"ord >= {a} and ord < {b}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files go by their time
    stories = Stories(spark, f"{tmp_path}/stories", ["mota"])
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stories.write(stream).trigger(availableNow=True).start()
    q.awaitTermination()
    told = {r["ord"]: (r["group_ord"]["ord"], r["cluster"]["ord"], r["cluster_country"]) for r in stories.assigned().collect()}
    want = {r["ord"]: (r["group_ord"]["ord"], r["cluster"]["ord"], r["cluster_country"]) for r in dedupe.clusters(df, ["mota"]).collect()}
    assert told == want and len({c for _, c, _ in want.values()}) < len({g for g, _, _ in want.values()}) < 90
    assert stories.assigned().select("batch").distinct().count() == 3
    before = stories.tables.versions("groups")
    stories.take(df.where("ord < 30"), 1)  # told again
    assert stories.tables.versions("groups") == before and stories.assigned().count() == 90
    stories.take(df.limit(0), 3)
    assert stories.assigned().count() == 90


def test_old_founders_leave_and_undated_ones_stay(spark, tmp_path):
    stories = Stories(spark, f"{tmp_path}/s", keep_days=7)
    rows = lambda *r: spark.createDataFrame(list(r), "ord long, canonical string, title string, country string, at string").selectExpr("ord", "canonical", "title", "country", "cast(at as timestamp) as date")
    stories.take(rows((1, "a", "alpha beta gamma", "FR", "2026-07-01"), (2, "b", "delta epsilon zeta", "FR", None)), 0)
    stories.take(rows((3, "c", "alpha beta gamma", "FR", "2026-07-20"), (4, "d", "delta epsilon zeta", "FR", "2026-07-20"), (5, "a", "other title here", "FR", "2026-07-20")), 1)
    assert {r["ord"]: r["cluster"]["ord"] for r in stories.assigned().collect()} == {1: 1, 2: 2, 3: 3, 4: 2, 5: 1}
