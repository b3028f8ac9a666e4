import random

import pytest

from candleflow.llm import quality_rules as R


def prose(words, n, seed):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(words) for _ in range(n))


LARGE = ["the", "of", "and", "house", "tree", "run", "sky", "sea", "hill", "bird", "go", "to"]
SMALL = ["agus", "an", "na", "teach", "crann", "rith", "spéir", "muir", "cnoc", "éan", "dul", "go"]
TINY = ["ja", "ei", "on", "talo", "puu", "juosta", "taivas", "meri", "lintu", "kukkula", "kun", "niin"]


@pytest.mark.parametrize("broadcast", [5_000, 0])
def test_a_language_below_one_percent_has_a_reference(spark, docs, monkeypatch, broadcast):
    monkeypatch.setattr(R, "BROADCAST_LANGS", broadcast)
    rows = [(i, prose(LARGE, 30_000, i), "en", "s") for i in range(20)]
    rows += [(100 + i, prose(SMALL, 150, i), "ga", "s") for i in range(20)]
    rows += [(200, prose(TINY, 150, 1), "fi", "s"), (201, prose(TINY, 150, 1), "en", "s"),
             (202, prose(TINY, 150, 2), "ga", "s"), (203, prose(LARGE, 150, 3), "ga", "s"),
             (204, prose(LARGE, 150, 4), None, "s")]
    df = docs(rows, [("_own", 1), ("_q", 2)])
    ref = R.fit_reference(df)
    assert list(ref.chars) == ["en"] and ref.n_small == 1
    out = R.with_verdict(df.where("doc_id >= 100"), ref).collect()
    got = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows) - 20 and not any(r["base_failed"] for r in out)
    assert all(got[100 + i]["kept"] and got[100 + i]["word_distance"] < 0.5 for i in range(20))
    # no usable reference: silent; words of neither language are still rejected
    assert got[200]["kept"] and got[200]["word_distance"] is None and got[200]["char_distance"] is None
    assert not got[201]["kept"] and not got[202]["kept"]
    assert got[203]["kept"] and got[204]["kept"] and got[204]["word_distance"] < 0.5


def test_no_language_of_one_percent(spark, docs):
    rows = [(i, prose([f"w{i}x{k}" for k in range(12)], 2_500, i), f"l{i}", "s") for i in range(120)]
    ref = R.fit_reference(docs(rows))
    assert not ref.chars and ref.n_small == 120
    new = docs([(0, prose([f"w0x{k}" for k in range(12)], 150, 1), "l0", "s"),
                (1, prose(TINY, 150, 1), "l0", "s"), (2, prose(TINY, 150, 1), None, "s")])
    got = {r["doc_id"]: r for r in R.with_verdict(new, ref).collect()}
    assert got[0]["kept"] and not got[1]["kept"] and got[2]["kept"] and got[2]["word_distance"] is None
