"""What the method adds beyond the base spans, and long texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from candleflow.llm import pii
from tests.llm.test_pii import brute


def minority(n=600):
    """A tenth of the phone numbers without prefix, a tenth of the addresses
    obfuscated; ids of those are divisible by 10."""
    rnd = random.Random(9)
    rows = []
    for i in range(n):
        number = f"({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}"
        rows.append((i, f"word other thing {'' if i % 10 == 0 else '+1 '}{number} and more text"))
        user, host = f"jo{rnd.randint(1, 9999)}", f"mail{rnd.randint(1, 9)}.example.com"
        address = f"{user}(at){host.replace('.', ' [dot] ')}" if i % 20 == 0 else f"{user} (at) {host}"
        rows.append((10_000 + i, f"word other {address if i % 10 == 0 else user + '@' + host} and more"))
    return rows


def added(rows):
    return {r["doc_id"]: [(x["s"], x["kind"], x["e"]) for x in r["spans"] if x not in r["base_spans"]] for r in rows}


def test_an_unchecked_minority_is_found(spark, docs):
    rows = minority()
    clean = [(20_000 + i, f"chapter {i} 12 of 30, 1999-12-31, 100 20 300 and v1.2.3") for i in range(300)]
    df = docs(rows + clean)
    model = pii.fit_pii(df)
    got = added(pii.with_spans(df, model).collect())
    wanted = {i for i, _ in rows if i % 10 == 0}
    hits = {i for i, spans in got.items() if len(spans) == 1}
    assert wanted <= hits and len(wanted) / len([s for s in got.values() if s]) >= 0.97
    text = dict(rows)
    for i in wanted:
        (s, _, e), = got[i]
        assert text[i][s:e].startswith("(" if i < 10_000 else "jo") and not text[i][s:e].endswith(" ")


def test_right_candidates_only(spark, docs):
    df = docs(minority())
    model = pii.fit_pii(df)
    assert set(model.thresholds) == {0, 3}
    assert sum(map(len, added(pii.with_spans(df, model).collect()).values())) == 120


def test_wrong_forms_are_never_added(spark, docs):
    bad = [(50_000, "user@host only"), (50_001, "(555) 55-55 short"), (50_002, "4111..1111..1111..1112 card"),
           (50_003, "300[.]1[.]1[.]1")]
    ips = [(60_000 + i, f"at 10.{i % 250}.3.{i % 199} now") for i in range(200)]
    cards = [(70_000 + i, "pay 4111 1111 1111 1111 now") for i in range(200)]
    df = docs(minority() + bad + ips + cards + [(80_000, "at 10[.]3[.]3[.]4 now"), (80_001, "pay 4111.1111.1111.1111 now")])
    got = added(pii.with_spans(df, pii.fit_pii(df)).collect())
    assert not any(got[i] for i, _ in bad)
    assert got[80_000] == [(3, 1, 17)] and got[80_001] == [(4, 2, 23)]


def test_redaction_inherits_additions_and_overlaps(spark, docs):
    df = docs(minority())
    model = pii.fit_pii(df)
    new = docs([(1, "word other jo1 (at) mail.example.com and"), (2, "é+49 123 4567 8@x.de or (555) 555-1234 x"), (3, None),
                (4, "")])
    rows = pii.with_spans(new, model).withColumn("r", pii.redacted(F.col("text"), F.col("spans"))).collect()
    got = {r["doc_id"]: r["r"] for r in rows}
    assert got == {1: "word other [EMAIL] and", 2: "é[PHONE] or [PHONE] x", 3: None, 4: ""}


def plain_redaction(text, spans):
    out, reach = [], 0
    for s, kind, e in sorted(spans):
        if s >= reach:
            out += [text[reach:s], f"[{pii.KINDS[kind].upper()}]"]
        reach = max(reach, e)
    return "".join(out) + text[reach:]


def test_replaced_pieces_equal_plain_slicing(spark, docs):
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice("ab é😀\n") for _ in range(rnd.choice([5, 900, 3000])))) for i in range(40)]
    spans = {}
    for i, t in rows:
        spans[i] = sorted((s, rnd.randrange(4), min(len(t), s + rnd.randint(1, 1500 if i % 3 else 9)))
                          for s in rnd.sample(range(len(t)), min(len(t), rnd.choice([0, 3, 600]))))
    df = spark.createDataFrame([(i, t, spans[i]) for i, t in rows],
                               "i int, t string, spans array<struct<s:int,kind:int,e:int>>")
    for r in df.select("i", pii.redacted(F.col("t"), F.col("spans")).alias("r"),
                       pii._blanked(F.col("t"), F.col("spans")).alias("b")).collect():
        text = dict(rows)[r["i"]]
        assert r["r"] == plain_redaction(text, spans[r["i"]])
        gone = {k for s, _, e in spans[r["i"]] for k in range(s, e)}
        assert r["b"] == "".join(pii.MASK if k in gone else c for k, c in enumerate(text))


@pytest.mark.parametrize("n", [5_000, 20_000])
def test_many_spans_in_one_text(spark, docs, n):
    text = " ".join(f"jo{i}@x.io" if i % 2 else f"(555) 555-{i % 9000 + 1000} é" for i in range(n))
    df = docs([(1, text)])
    model = pii.PiiModel([], {0: 0.5, 3: 0.5})
    t0 = time.time()
    row = pii.with_spans(df, model).select("base_spans", "spans", F.length(pii.redacted(
        F.col("text"), F.col("spans"))).alias("n")).collect()[0]
    assert time.time() - t0 < 60
    assert len(row["spans"]) == n and len(row["base_spans"]) == n // 2
    assert [(x["s"], x["kind"], x["e"]) for x in row["base_spans"]] == brute(text)
    assert row["n"] == len(plain_redaction(text, [(x["s"], x["kind"], x["e"]) for x in row["spans"]]))
