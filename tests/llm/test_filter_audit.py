import random
from fractions import Fraction
from itertools import permutations

from pyspark.sql import functions as F

from candleflow.llm import filter_audit as A

LABELS = "doc_id long, quality int, toxic int"


def audit(spark, docs, labels=()):
    return A.audit_documents(docs, spark.createDataFrame(list(labels), LABELS)).collect()


def brute(masks, order):
    """(kept, removed, redundant) of every step by walking the documents."""
    out, gone = [], set()
    for f in order:
        fails = {i for i, m in enumerate(masks) if m >> f & 1}
        now = fails - gone
        out.append((len(masks) - len(gone | fails), len(now), len(fails & gone)))
        gone |= fails
    return out


def test_against_walking_every_order(spark):
    rng = random.Random(5)
    masks = [rng.choice([0, rng.randrange(32)]) for _ in range(300)]
    good = [rng.random() < 0.4 for _ in masks]
    toxic = [rng.random() < 0.2 for _ in masks]
    counts = {k: [0] * 32 for k in ("n", "good", "toxic")}
    for m, g, t in zip(masks, good, toxic):
        counts["n"][m] += 1
        counts["good"][m] += g
        counts["toxic"][m] += t
    out = A.audit_part("x", counts)
    rows = {(o, s): i for i, (o, s) in enumerate(zip(out["filter_order"], out["step"]))}
    assert len(rows) == 600
    shares = [0] * 5
    for order in permutations(range(5)):
        name, gone = "".join("ABCDE"[i] for i in order), 0
        for step, (kept, removed, redundant) in enumerate(brute(masks, order), 1):
            i, f = rows[name, step], order[step - 1]
            assert (out["kept"][i], out["removed"][i], out["redundant"][i]) == (kept, removed, redundant)
            here = [j for j, m in enumerate(masks) if m >> f & 1 and not m & gone]
            assert out["good_lost"][i] == sum(good[j] for j in here)
            assert out["toxic_lost"][i] == sum(toxic[j] for j in here)
            assert out["unique_fails"][i] == masks.count(1 << f)
            shares[f] += removed
            gone |= 1 << f
    assert all(out["shapley"][i] == shares["ABCDE".index(o[s - 1])] for (o, s), i in rows.items())


def test_shapley_is_exact_for_any_game():
    rng = random.Random(8)
    for n in (1, 2, 3, 4):
        v = [0] + [rng.randrange(-50, 50) for _ in range((1 << n) - 1)]
        want = [Fraction(0)] * n
        orders = list(permutations(range(n)))
        for order in orders:
            before = 0
            for f in order:
                want[f] += Fraction(v[before | 1 << f] - v[before], len(orders))
                before |= 1 << f
        assert A.shapley(v, n) == want


def test_failures(spark, docs):
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    cases = {
        1: (words(200), 0), 2: (words(199), 1), 3: ("a " * 400, 2), 4: ("ab AB " + words(300) + "É" * 60, 0),
        5: (words(200) + " #", 8), 6: (words(200) + " $", 8), 7: ("", 1), 8: (None, 1 | 16), 9: ("ABC", 1 | 4),
        10: (words(200), 16), 11: ("A a" + " x" * 98, 1 | 2), 12: ("W" * 30 + words(300), 0),
    }
    rows = docs([(i, t) for i, (t, _) in cases.items()])
    got = {r["id"]: r["mask"] for r in A.with_failures(rows).collect()}
    assert got == {i: m for i, (_, m) in cases.items()}


def test_copies_nulls_and_repeats(spark, docs):
    rows = docs([(5, "same"), (5, "same"), (7, "same", None, "s"), (9, "same"), (None, "same"), (None, "other"),
                 (3, "Same")], extra=[("mask", 1), ("n", 2), ("digest", "x"), ("id", 4), ("part", "z")])
    got = sorted(((r["id"] or -1), r["part"], r["mask"] >> 4, r["n"]) for r in A.with_failures(rows).collect())
    assert got == [(-1, "en", 0, 1), (-1, "en", 0, 1), (3, "en", 0, 1), (5, "en", 0, 2), (7, "", 1, 1), (9, "en", 1, 1)]
    out = audit(spark, rows, [(5, 1, 0), (5, 0, 1), (7, None, None), (None, 1, 1), (9, 0, None)])
    assert len(out) == 2 * 600 and {r["part"] for r in out} == {"", "en"}
    one = {(r["part"], r["filter_order"], r["step"]): r for r in out}
    first = one["en", "ABCDE", 1]  # every text is short; the label of id 5 counts for both its rows
    assert (first["removed"], first["kept"], first["good_lost"], first["toxic_lost"]) == (6, 0, 2, 2)
    assert one["en", "EABCD", 1]["removed"] == 1 and one["", "EABCD", 1]["removed"] == 1
    assert one["en", "ABCDE", 5]["redundant"] == 1


def test_empty_and_hot_text(spark, docs):
    assert audit(spark, docs([])) == []
    df = docs([(i, "copy " * 10) for i in range(4000)] + [(10_000 + i, f"text {i}") for i in range(100)])
    out = {(r["filter_order"], r["step"]): r for r in audit(spark, df.withColumn("lang", F.lit("xx")))}
    assert out["EABCD", 1]["removed"] == 3999 and out["ABCDE", 5]["redundant"] == 3999
