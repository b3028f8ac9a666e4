import random
import re

import pytest

from candleflow.llm import pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
            r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def brute(text):
    out = []
    for kind, rx in enumerate(PATTERNS):
        for m in re.finditer(rx, text or ""):
            g = m.group()
            n = sum(c.isdigit() for c in g)
            if [True, kind == 1 and all(int(p) <= 255 for p in g.split(".")), 12 <= n <= 19 and luhn(g),
                    9 <= n <= 15][kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


CASES = [None, "", "a@b.c_d@e.f", "x@y@z.w.", "a@b a@b.c.", "é😀 jo.1@mail.example.com, x", "1.2.3.4.5.6.7.8.9",
         "300.1.2.3 1..2.3.4.5 0000255.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112 5", "+1 (443) 555-5793.",
         "+1 ((((", "+12345678901234567890", "4111111111111111@x.io +49 170 1234567-", "12 34 56 78 90 12 34 56 78 90 1",
         "5 6  4111111111111111", "é" * 300 + " 9.9.9.9", "1" * 30_000, "a" * 30_000 + "@", "1.1.1.1 " * 700,
         "+5 " * 3000, "a@b.co " * 900]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    pool = ["@", ".", "-", " ", "+", "(", ")", "_", "a", "b", "Z", "1", "2", "4", "41", "999", "é", "😀", "\n"]
    return CASES + ["".join(rnd.choice(pool) for _ in range(rnd.randint(5, 80))) for _ in range(1500)] + [
        "4" + "".join(rnd.choice("0123456789") for _ in range(rnd.randint(11, 19))) for _ in range(300)]


def test_base_spans_equal_brute_force(spark, docs, texts):
    rows = list(enumerate(texts))
    df = docs(rows + rows[:3], [("spans", "x"), ("_t", 1), ("_base", 2), ("kind", 3)])
    got = pii.with_spans(df, None).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        assert [(x["s"], x["kind"], x["e"]) for x in r["base_spans"]] == brute(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_redaction(spark, docs):
    from pyspark.sql import functions as F
    df = docs([(1, "mail jo@x.org or +1 (443) 555-5793 now"), (2, None), (3, "none"),
               (4, "4111111111111111@x.io!")])
    rows = pii.with_spans(df, None).withColumn("r", pii.redacted(F.col("text"), F.col("spans")))
    assert {r["doc_id"]: r["r"] for r in rows.collect()} == {
        1: "mail [EMAIL] or [PHONE] now", 2: None, 3: "none", 4: "[EMAIL]!"}


def phones(n=400):
    rnd = random.Random(5)
    number = lambda: f"({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}"
    rows = []
    for i in range(n):
        if i % 2:
            rows.append((i, f"please call me +1 {number()} soon"))
        else:
            rows.append((i, f"part no={rnd.randint(200, 999)}-{rnd.randint(100, 999)}-{rnd.randint(1000, 9999)}x in stock"))
    return rows


def test_trees_add_what_looks_like_checked_data(spark, docs):
    df = docs(phones())
    model = pii.fit_pii(df)
    assert pii.KINDS.index("phone") in model.thresholds
    new = docs([(1, "please call me (443) 555-5793 soon"), (2, "part no=443-555-5793x in stock"), (3, None),
                (4, "please call me +1 (443) 555-5793 soon")])
    got = {r["doc_id"]: r for r in pii.with_spans(new, model).collect()}
    assert [(x["s"], x["e"]) for x in got[1]["spans"]] == [(15, 29)] and not got[1]["base_spans"]
    assert not got[2]["spans"] and not got[3]["spans"]
    assert got[4]["spans"] == got[4]["base_spans"] and len(got[4]["spans"]) == 1
    assert pii.fit_pii(df.limit(0)) is None and pii.with_spans(df.limit(0), model).count() == 0


def test_tree_expression_equals_the_library(spark, docs):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F
    rnd = random.Random(1)
    rows = [([rnd.random() for _ in range(4)]) for _ in range(300)]
    train = spark.createDataFrame([(Vectors.dense(x), float(x[0] + x[2] > 1 or x[1] > .9)) for x in rows], ["x", "y"])
    fitted = GBTClassifier(featuresCol="x", labelCol="y", maxIter=6, maxDepth=3, seed=1).fit(train.coalesce(1))
    model = pii.PiiModel(pii.read_trees(fitted.toDebugString), {})
    both = fitted.transform(train).select(
        vector_to_array("probability")[1].alias("p"), model.rating(vector_to_array("x")).alias("q")).collect()
    assert len(model.trees) == 6 and all(abs(r["p"] - r["q"]) < 1e-9 for r in both)
    assert model.rating(F.array(*[F.lit(0.5)] * 4)) is not None
