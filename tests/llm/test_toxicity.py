import random

import pytest
from pyspark.sql import functions as F

from candleflow.llm import toxicity as X
from candleflow.llm.common import table
from candleflow.llm.labelled import labelled_sample
from candleflow.llm.queries import op3_toxicity

TERMS = [("idiot", False, 5.0), ("lowei", True, 4.0), ("worthless", False, 6.0), ("scum", False, 3.0)]


def distance_rows(a, b):
    row = list(range(len(b) + 1))
    yield row[-1]
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        yield row[-1]


def brute(word):
    best = None
    for term, stem, weight in TERMS:
        per_prefix = list(distance_rows(word, term))
        e = min(per_prefix) if stem else per_prefix[-1]
        if e <= X.edits_allowed(term) and (best is None or (-e, weight) > best):
            best = (-e, weight)
    return best


def test_automaton_equals_brute_force():
    rnd, lexicon = random.Random(1), X.FuzzyLexicon(TERMS)
    for _ in range(20_000):
        w = rnd.choice(["idiot", "lowei", "worthless", "scum", "loweitzen", "words"])
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randint(0, len(w))
            w = rnd.choice([w[:i] + rnd.choice("ioxwe") + w[i:], w[:i] + w[i + 1:], w[:i] + "x" + w[i + 1:]])
        assert lexicon.match(w) == brute(w), w
    assert X.FuzzyLexicon([]).match("idiot") is None


def test_quotation_is_not_abuse():
    quoted = X.Reader.quoted
    assert quoted("he called him an idiot today".split(), 4)
    assert quoted('they wrote: "you idiot!" and left'.split(), 3)
    assert not quoted("you idiot go".split(), 1)
    reader = X.Reader(TERMS, frozenset(["idiom"]))
    assert reader.features("the idiom")[:4] == [0, 0, 0, 0]  # clean documents use it
    strong = reader.features("You IDIOT!!")
    fuzzy = reader.features("you idoit1 idiott")
    said = reader.features("she said idiot once")
    assert strong[0] > 0 and fuzzy[2] > 0 and fuzzy[0] == 0 and said[3] > 0 and said[0] == 0


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(7)
    clean = [f"{a}{b}" for a in "bcdfgh" for b in ("arn", "elt", "imp", "oga")]
    rows = []
    for i in range(600):
        words = [rnd.choice(clean) for _ in range(30)]
        bad = i % 3 == 0
        if bad:
            for _ in range(3):
                words[rnd.randrange(30)] = rnd.choice(["idiot", "scumbag", "zlorp" + rnd.choice(["en", "ung", "t"])])
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_learned_lexicon_and_scores(spark, docs, corpus):
    df = docs([(i, t) for i, t, _ in corpus])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in corpus] + [(None, 1, 1), (3, 1, None), (5, 0, 7)],
                                   "doc_id long, quality int, toxic int")
    model = X.fit_toxic(labelled_sample(df, labels, "toxic", F.col("doc_id") < 400, 1000))
    assert any(w.startswith("zlorp") and stem for w, stem, _ in model.terms)
    extra = docs([(1000, None), (1001, ""), (1002, "IDIOT, you zlorpich!"), (1003, "barn " * 50_000),
                  (1004, "you idiott and scumbagg, zlorpen"), (1004, "you idiott and scumbagg, zlorpen")],
                 [("score", "x"), ("_toxic", 1)])
    got = {r["doc_id"]: r["score"] for r in X.with_toxicity(extra, model).collect()}
    assert all(got[i] < 0.5 for i in (1000, 1001, 1003)) and got[1002] >= 0.5 and got[1004] >= 0.5
    held = {r["doc_id"]: r["score"] >= 0.5 for r in X.with_toxicity(df.where("doc_id >= 400"), model).collect()}
    assert sum(held[i] == bool(y) for i, _, y in corpus if i >= 400) >= 198
    assert X.fit_toxic(labelled_sample(df, labels.limit(0), "toxic", F.lit(True), 10)) is None
    assert [r["score"] for r in X.with_toxicity(extra.limit(2), None).collect()] == [0.0, 0.0]
    assert X.with_toxicity(extra.limit(0), model).count() == 0


def test_query(spark):
    rows = op3_toxicity(spark, "/root/testdata/sf0.001").toPandas()
    assert list(rows.columns) == ["doc_id", "held_out", "score", "predicted"]
    assert len(rows) == table(spark, "/root/testdata/sf0.001", "documents").count()
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.5) == (rows.predicted == 1)).all()
