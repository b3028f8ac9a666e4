"""Quotas by highest quotients, through the library; hot and repeated ids."""

import random

from pyspark.sql import functions as F

from candleflow.llm import mixing as M
from tests.llm.test_mixing import highest_quotients


def library(spark, votes, seats):
    df = spark.createDataFrame([(f"p{i:05d}", float(v)) for i, v in enumerate(votes)], "k string, votes double")
    rows = M.highest_quotients(df, seats, ["k"]).orderBy("k").collect()
    return [r["seats"] for r in rows]


def test_seats_equal_the_priority_queue(spark, monkeypatch):
    rnd = random.Random(1)
    cases = [([rnd.uniform(0.1, 5000) for _ in range(n)], seats) for n, seats in ((1, 7), (2, 1), (5, 0), (9, 250), (40, 997))]
    cases += [([10.0] * 7, 17), ([1.0, 3.0, 9.0, 27.0], 20), ([5.0, 0.0, 5.0], 3), ([1e-3, 1e6], 500), ([0.0], 4)]
    for votes, seats in cases:
        want = highest_quotients(votes, seats) if any(votes) else [0] * len(votes)
        assert library(spark, votes, seats) == want, (votes, seats)
    monkeypatch.setattr(M, "FEW", 0)  # down to neighbouring numbers
    assert library(spark, *cases[3]) == highest_quotients(*cases[3])
    assert library(spark, *cases[5]) == highest_quotients(*cases[5])


def test_block_quotas_of_the_plan(spark, docs):
    """Every shard gets its seats, and its part of its source's cut block."""
    rnd = random.Random(2)
    df = docs([(i, " ".join(["w"] * rnd.randint(1, 90)), "en", rnd.choice("aaaabbc")) for i in range(600)])
    plan = M.mix_plan(df, block=32, shard_words=3_000)
    sizes = plan.select("id", "size", "source_size", "target").join(
        df.select(F.col("doc_id").alias("id"), F.col("source").alias("_source"), F.xxhash64("text").alias("_hash")), "id")
    rows = sizes.select(F.col("id").alias("_id"), "_source", F.col("size").alias("_size"), "_hash")
    src = sizes.select(F.col("_source").alias("source"), "source_size", "target").distinct()
    dealt = M._with_shards(rows, src, 3_000, M.SEED)
    party = {(r["_source"], r["_shard"]): r for r in dealt.groupBy("_source", "_shard").agg(
        F.sum("_size").alias("w"), F.first("target").alias("t"), F.first("source_size").alias("s")).collect()}
    keys = sorted(party)
    votes = [party[k]["t"] * party[k]["w"] / party[k]["s"] for k in keys]
    seats = dict(zip(keys, highest_quotients(votes, sum(r["w"] for r in party.values()) // 32)))
    quotas = {(r["_source"], r["_shard"]): r["_quota"] for r in M.shard_quotas(dealt, 32).collect()}
    assert quotas.keys() == seats.keys()
    for source in "abc":
        own = [k for k in keys if k[0] == source]
        assert sum(quotas[k] for k in own) == round(party[own[0]]["t"])
        rest = [quotas[k] - 32 * seats[k] for k in own]
        assert max(rest) - min(rest) <= 1


def test_rows_of_one_id_are_spread_and_agree_again(spark, docs):
    rows = [(None, f"text {i} of a null id", "en", "a") for i in range(3000)]
    rows += [(7, f"text {i} of one id", "en", "a") for i in range(1000)] + [(i, "x y z", "en", "a") for i in range(100, 2100)]
    df = docs(rows)
    sized = df.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"),
                      M.word_count(F.col("text")).alias("_size"), F.xxhash64("text").alias("_hash"))
    src = M.source_targets(sized.select(F.col("_source").alias("source"), F.col("_size").alias("size")))
    n = [r["count"] for r in M._with_shards(sized, src, 1_000, 5).groupBy("_shard").count().collect()]
    assert max(n) < 2 * sum(n) / len(n)
    key = ["id", "size", "taken", "passes"]
    one = sorted(map(str, M.mix_plan(df, shard_words=2_000).select(*key).collect()))
    two = sorted(map(str, M.mix_plan(df.repartition(9), shard_words=2_000).select(*key).collect()))
    assert one == two and len(one) == len(rows)
    texts = lambda d: sorted(r["text"] for r in M.mix_documents(d, block=2, shard_words=2_000).collect())
    assert texts(df) == texts(df.repartition(4))
