import math
import random
import zlib
from collections import Counter

import pytest

from candleflow.llm import brown_lm as B


def made(n=300):
    rnd = random.Random(8)
    nouns = [f"noun{i}" for i in range(12)]
    verbs = [f"verb{i}" for i in range(12)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rnd.randint(1, 30)):
            words += ["The", rnd.choice(nouns), rnd.choice(verbs)]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("frequent, own", [(1e-6, 2e-5), (0.02, 0.05)])
def test_base_scores_and_counts_equal_brute_force(spark, docs, monkeypatch, frequent, own):
    monkeypatch.setattr(B, "FREQUENT", frequent)
    monkeypatch.setattr(B, "OWN_UNIT", own)
    monkeypatch.setattr(B, "CLASSES", 8)
    rows = made() + [(1000, None), (1001, ""), (1002, "unseen wörds \x0b only here"), (1003, "THE the tHe"),
                     (10, "repeated id"), (1004, "noun1 verb2 " * 20_000)]
    df = docs(rows, [("rid", 1), ("units", "x"), ("held", 0), ("n_tokens", 5)])
    got = B.score_documents(df).collect()
    train, ends = Counter(), 0
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            train.update((t or "").encode().lower().split())
            ends += 1
    n, v = sum(train.values()) + ends, len(train) + 1
    want = Counter()
    for i, t in rows:
        counts = [train[w] for w in (t or "").encode().lower().split()] + [ends]
        base = sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in counts)
        want[(i, zlib.crc32(str(i).encode()) % 10 == 0, len(counts), sum(c > 0 for c in counts), n, round(base, 4))] += 1
    assert Counter((r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4))
                   for r in got) == want
    held = [r for r in got if r["held_out"] and 0 < r["id"] < 300]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in got)


def test_probabilities_sum_to_one(spark, docs, monkeypatch):
    monkeypatch.setattr(B, "CLASSES", 8)
    model, encoded, _ = B.fit_and_encode(docs(made(80)))
    for row in model.log_next:
        assert sum(10 ** x for x in row) == pytest.approx(1.0)
    words = model.words
    total = Counter()
    for w, i in words.index.items():
        total[model.classes[words.unit[i]]] += 10 ** words.log_count[i]
    for c, mass in total.items():  # known words, and one share for all unknown ones
        assert mass / 10 ** model.log_size[c] + B.DELTA / 10 ** model.log_size[c] == pytest.approx(1.0)


def test_exchange_finds_the_word_classes(spark, docs, monkeypatch):
    monkeypatch.setattr(B, "CLASSES", 5)
    model, *_ = B.fit_and_encode(docs(made()))
    of = lambda w: model.classes[model.words.unit[model.words.index[w.encode()]]]
    nouns, verbs = {of(f"noun{i}") for i in range(12)}, {of(f"verb{i}") for i in range(12)}
    assert not nouns & verbs and of("the") not in nouns | verbs


def test_empty_table_and_no_training_rows(spark, docs):
    df = docs([(i, "a b") for i in range(40)])
    assert B.score_documents(df.limit(0)).count() == 0
    only_held = B.score_documents(df.where("crc32(cast(doc_id as string)) % 10 = 0")).collect()
    assert only_held and all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"])
                             for r in only_held)
