"""What the third round of findings found."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tradewind.llm import minhash_join, near_sets
from tradewind.operators import relational as R
from tradewind.plans import catalogue, layers, registry


def test_valid_side_parses_a_record_once(spark):
    kafka = spark.createDataFrame([], layers.KAFKA)
    valid, rejected = layers.split(layers.bronze(kafka), "bronze_errors")
    for side in (valid, rejected):
        assert side._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_repeated_intervals_stay_in_their_run(spark, monkeypatch):
    """Of equal intervals of one record the first begins a run; the others stay in it, however files give the rows back."""
    real = R.landed

    def backwards(df, label):
        mark = [F.desc("__later")] if "__later" in df.columns else [F.asc("__fresh")] if "__fresh" in df.columns else []
        return real(df.coalesce(1).sortWithinPartitions(*mark) if mark else df, label)

    monkeypatch.setattr(R, "landed", backwards)
    day = lambda n: date(2024, 1, 1) + timedelta(n)
    rows = [("s", f"r{i}", day(20 * i + a), day(20 * i + a)) for i in range(50) for a in (0, 9, 9, 9)] + [("s", f"x{i}", day(20 * i + 4), day(20 * i + 4)) for i in range(50)]
    df = spark.createDataFrame(rows, "subject string, record string, valid_from date, valid_to date")
    assert R.conflicts(df, ["subject"], "record").count() == 0


@pytest.mark.parametrize("name", ["ops_current", "ops_daily", "eco_spend_allocation", "eco_orders", "eco_campaign", "eco_cohort", "gate_economics", "bi_incomplete_economics"])
def test_tasks_do_not_grow_with_the_table(spark, monkeypatch, name):
    """Lines are dealt into more parts as their table grows."""
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(registry, "SHARE", 1 << 12)
    n = registry.shares(spark, sf, "lineitem")
    assert n > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert f", {n}), REPARTITION_BY_NUM" in catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_current_state_makes_no_event_rows(spark):
    assert "Generate" not in catalogue.QUERIES["ops_current"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_near_stage_goes_through_fingerprints(spark, monkeypatch):
    """Near copies within the radius are linked by their fingerprints; the join of signatures is left with no pair of them."""
    joined, real = [], minhash_join.against_least

    def seen(lists):
        pairs = real(lists)
        joined.append(pairs.count())
        return pairs

    monkeypatch.setattr(minhash_join, "against_least", seen)
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    rows = [(i, " ".join([*base, f"end{i}"])) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_sets.near_sets(docs).collect()} == {(i, 0) for i in range(12)}
    assert joined == [0]


def test_sets_are_made_of_colliding_nodes_only(spark, monkeypatch):
    """Texts with 60 of 100 words in common (0.4) stand in common lists, but those with too few collisions with a hub aren't fetched for it."""
    asked, listed, real, lists = [], [], minhash_join.node_sets, minhash_join.prefix_lists

    def seen(nodes):
        out = lists(nodes)
        listed.append(out.select("node").distinct().count())
        return out

    monkeypatch.setattr(minhash_join, "prefix_lists", seen)
    monkeypatch.setattr(minhash_join, "node_sets", lambda docs, wanted, words: (asked.append(wanted.count()), real(docs, wanted, words))[1])
    rng = random.Random(3)
    frame = " ".join(f"f{i}" for i in range(60))
    docs = spark.createDataFrame([(i, frame + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))) for i in range(60)], "doc_id long, text string").repartition(4)
    assert minhash_join.near_duplicates(docs, words=5).filter("kept").count() == 60
    assert listed[0] > 20 and asked[0] < listed[0] / 2


def test_likely_pairs_unite_a_group_before_the_rest(spark, monkeypatch):
    """Of 40 texts in a chain of links all pairs are allowed; those likely ones that are links leave none to compare."""
    pairs = spark.createDataFrame([(u, v, 100 - (u - v)) for u in range(40) for v in range(u)], "u long, v long, common long")
    first = minhash_join.likely(pairs)
    assert first.count() == sum(min(u, minhash_join.FEW) for u in range(40))
    links = first.filter("u - v = 1")
    assert links.count() == 39
    assert minhash_join.apart(pairs.select("u", "v"), links).count() == 0
    assert minhash_join.apart(pairs.select("u", "v"), links.filter("u <> 20")).count() == 20 * 20


def test_near_steps_drop_the_encoders_of_others(spark):
    from tradewind.llm import common, fertility

    held = {"k": 1}
    common.KEPT.append(held)
    try:
        common.forget()
        assert not held and any(x is fertility._POOLS for x in common.KEPT)
    finally:
        common.KEPT.remove(held)
