"""Versioned tables, the consumer whose effects happen once, and layers that are stopped and go on."""

import threading

import pytest
from pyspark.sql import functions as F

from tradewind.plans import layers
from tradewind.sources.tables import Conflict, Table
from tradewind.streaming.consumer import Consumer


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_readers_never_see_a_mixture(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t")
    make = lambda k: spark.range(50, numPartitions=4).select("id", F.lit(k).alias("v"))
    t.replace(make(0))
    seen, faults, stop = set(), [], threading.Event()

    def reader():
        mine = Table(spark, f"file://{tmp_path}/t")
        while not stop.is_set():
            try:
                got = mine.read().groupBy("v").count().collect()
                if len(got) != 1 or got[0]["count"] != 50:
                    faults.append(got)
                seen.add(got[0].v)
            except Exception as e:  # noqa: BLE001
                faults.append(e)

    x = threading.Thread(target=reader)
    x.start()
    for k in range(1, 21):
        assert t.replace(make(k)) == k + 1
    stop.set()
    x.join()
    assert not faults and len(seen) > 3
    assert rows(t.read(5).select("v").distinct()) == [(4,)]
    assert len(t.vacuum(keep=2)) == 19 and t.versions() == [20, 21] and t.read().count() == 50


def test_one_of_two_writers_loses(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t")
    with pytest.raises(ValueError):
        t.read()
    assert t.read(schema="id long").count() == 0
    t.replace(spark.range(3))
    t.replace(spark.range(5), expected=1)
    with pytest.raises(Conflict):
        t.replace(spark.range(7), expected=1)
    with pytest.raises(ValueError):
        t.replace(spark.range(9), valid=lambda df: df.count() == 1)
    assert t.read().count() == 5 and t.versions() == [1, 2]
    # a writer whose version was taken meanwhile makes its rows anew
    df = spark.createDataFrame([(1, "new"), (9, "new"), (None, "new")], "id long, v string")
    t = Table(spark, f"file://{tmp_path}/u")
    t.upsert(df.withColumn("v", F.lit("old")), ["id"])
    stage, done = t.stage, []

    def overtaken(x, by=()):
        if not done:
            done.append(Table(spark, f"file://{tmp_path}/u").upsert(spark.createDataFrame([(4, "other")], "id long, v string"), ["id"]))
        return stage(x, by)

    t.stage = overtaken
    assert t.upsert(df, ["id"]) == 3
    assert rows(t.read()) == [(1, "new"), (4, "other"), (9, "new"), (None, "new")]
    assert t.upsert(df.limit(0), ["id"]) == 4 and t.read().count() == 4


def test_tenants_at_once(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t")
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "business_id string, x int")
    t.replace_tenants(df)
    t.replace_tenants(spark.createDataFrame([("a", 9), (None, 8)], "business_id string, x int"))
    assert rows(t.read()) == [("a", 9), ("b", 3), (None, 8)]


def test_a_batch_that_dies_counts_once(spark, tmp_path):
    base = f"file://{tmp_path}"
    spark.range(0, 40, numPartitions=3).write.parquet(f"{base}/in")
    process = lambda df: df.withColumn("failures", F.when(F.col("id") % 10 == 0, F.array(F.lit("tens"))).when(F.col("id") % 3 == 0, F.array(F.lit(None).cast("string"))))
    stream = lambda: spark.readStream.schema("id long").parquet(f"{base}/in")
    take, deaths = Consumer.take, []

    class Dying(Consumer):
        """Dies after a batch's write the first time, before the second commit the next, then not at all."""

        def take(self, batch, number):
            if len(deaths) == 1:
                self.good.append = lambda *a: (_ for _ in ()).throw(RuntimeError("died between the commits"))
            take(self, batch, number)
            raise RuntimeError("died after the commits")

    for expected in ("after", "between"):
        with pytest.raises(Exception, match=f"died {expected}"):
            Dying(spark, f"{base}/out", process).start(stream(), f"{base}/checkpoint").awaitTermination()
        deaths.append(expected)
        if expected == "after":
            spark.range(40, 60).write.mode("append").parquet(f"{base}/in")
            c = Consumer(spark, f"{base}/out", process)
            assert c.state() == {"batch": 0, "done": 36, "failed": 4}
            # the first batch comes again, is skipped and over; then the second dies between its commits
            c.start(stream(), f"{base}/checkpoint").awaitTermination()
            assert c.state() == {"batch": 1, "done": 54, "failed": 6}
            spark.range(60, 70).write.mode("append").parquet(f"{base}/in")
    c = Consumer(spark, f"{base}/out", process)
    assert c.last_batch(c.bad) == 2 and c.last_batch(c.good) == 1
    c.start(stream(), f"{base}/checkpoint").awaitTermination()
    assert c.state() == {"batch": 2, "done": 63, "failed": 7}
    assert rows(c.good.read()) == sorted(((i,) for i in range(70) if i % 10), key=repr)
    assert sorted(r.id for r in c.bad.read().collect()) == [0, 10, 20, 30, 40, 50, 60]
    c.start(stream(), f"{base}/checkpoint").awaitTermination()
    assert c.state()["batch"] == 2


def test_layers_go_on_where_they_stopped(spark, tmp_path):
    base = f"file://{tmp_path}"
    record = '{{"business_id":"biz_1","source_type":"shopify","source_id":"src","schema_version":"1","event_id":"{0}","event_type":"product_viewed","event_timestamp":"2024-01-{1:02d} 00:00:00","customer_id":"c","country":"us","currency":"usd"}}'

    def arrive(*events):
        data = [(b"biz_1|c", record.format(e, d).encode(), "t", 0, k) for k, (e, d) in enumerate(events)]
        spark.createDataFrame(data, "key binary, value binary, topic string, partition int, offset long").withColumn("timestamp", F.lit("2024-01-01").cast("timestamp")).select(*[c.split(" ")[0] for c in layers.KAFKA.split(", ")]).write.mode("append").parquet(f"{base}/in")

    def ids():
        good, bad = layers.run_chain(spark, f"{base}/in", f"{base}/out")
        return sorted(r.event_id for r in good.collect()), bad.count()

    arrive(("a", 1), ("b", 20), ("b", 20), ("c", 18))
    assert ids() == (["a", "b", "c"], 0)
    assert ids() == (["a", "b", "c"], 0)  # nothing new
    # c again within seven days of the newest; a again and d for the first time, both older than that; e new
    arrive(("c", 18), ("a", 1), ("d", 2), ("e", 14))
    assert ids() == (["a", "b", "c", "e"], 0)
    arrive(("f", 29), ("e", 14))
    assert ids() == (["a", "b", "c", "e", "f"], 0)
