import random
from collections import Counter

from pyspark.sql import functions as F

from candleflow.llm import quality_rules as R
from candleflow.llm import quality_zstd as Z
from candleflow.llm.labelled import labelled_sample


def made(n=400):
    rnd = random.Random(3)
    syllables = ["an", "der", "th", "ing", "or", "re", "st", "ly"]
    rows = []
    for i in range(n):
        words = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(80)]
        good = i % 2 == 0
        rows.append((i, " ".join(words if good else [w + "###" for w in words]), int(good)))
    return rows


def test_compression_classifier(spark, docs):
    rows = made()
    df = docs([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = Z.fit_quality(labelled_sample(df, labels, "quality", F.col("doc_id") < 300, 1000))
    got = {r["doc_id"]: r["score"] for r in Z.with_quality(df, model).collect()}
    assert sum((got[i] >= 0.7) == bool(y) for i, _, y in rows if i >= 300) >= 98
    odd = docs([(1, None), (2, ""), (3, rows[0][1] * 500), (3, rows[0][1] * 500)], [("score", "x")])
    scores = [(r["doc_id"], r["score"]) for r in Z.with_quality(odd, model).collect()]
    assert len(scores) == 4 and all(0 <= s <= 1 for _, s in scores)
    assert len({s for i, s in scores if i == 3}) == 1 and len({s for i, s in scores if i < 3}) == 1
    one = labelled_sample(df, labels.where("quality = 1"), "quality", F.lit(True), 10)
    assert Z.fit_quality(one) is None
    assert {r["score"] for r in Z.with_quality(odd, None).collect()} == {0.5}
    assert Z.with_quality(odd.limit(0), model).count() == 0


def test_sample_is_bounded_and_repeatable(spark, docs):
    rows = made(100)
    df = docs([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    take = lambda d, n: sorted(r["t"] for r in labelled_sample(d, labels.repartition(n), "quality", F.lit(True),
                                                               20).collect())
    assert take(df, 2) == take(df.repartition(7), 5) and len(take(df, 1)) == 40


def brute_rules(text):
    words = [w.decode() for w in (text or "").encode().split()]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [s for s in (text or "").split("\n") if s.encode().split()]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered))


def test_base_rules_equal_brute_force(spark, docs):
    rnd = random.Random(9)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a a a a", "a b c a b c", "é ñ é ñ é ñ", "x y z\x85w",
             "one\n\none\r\none\n \n", "a | b <> #*$%&", "b " * 20_000,
             " ".join(f"w{i % 700}" for i in range(9_000))]
    for _ in range(60):
        n, v = rnd.randint(1, 300), rnd.randint(2, 60)
        texts.append("".join(f"w{rnd.randint(0, v)}" + rnd.choice([" ", " ", "\n", "\t "]) for _ in range(n)))
    rows = list(enumerate(texts))
    df = docs(rows + rows[:4], [("n_words", "x"), ("_w", 1), ("_k", 2), ("kept", 0)])
    got = R.with_base_rules(df).collect()
    assert len(got) == len(rows) + 4
    for r in got:
        want = brute_rules(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def distance(p, q):
    from math import log2, sqrt
    total = 0.0
    for k in set(p) | set(q):
        a, b = p.get(k, 0.0), q.get(k, 0.0)
        m = (a + b) / 2
        total += (a * log2(a / m) if a else 0) / 2 + (b * log2(b / m) if b else 0) / 2
    return sqrt(max(0.0, total))


def brute_chars(text):
    import re
    counts = {k: len(re.sub(rx, "", text)) for k, rx in R.CLASSES.items()}
    counts["other"] = len(text) - sum(counts.values())
    return counts


def test_divergence_equals_brute_force(spark, docs):
    rnd = random.Random(2)
    langs = {"en": ["the", "of", "and", "house", "tree", "run", "sky"], "de": ["der", "und", "über", "haus", "baum"]}
    rows = [(i, " ".join(rnd.choice(langs[k]) for _ in range(200)) + ".", k, "s")
            for i, k in enumerate(["en", "de"] * 30)]
    junk = [(100, "#### 123 " * 60, "en", "s"), (101, None, None, None), (102, "the of", "xx", "s")]
    df = docs(rows + junk, [("char_distance", 1.0)])
    ref = R.fit_reference(df)
    texts = {i: t or "" for i, t, *_ in rows + junk}
    for lang in ("en", "de"):
        own = [t or "" for _, t, k, _ in rows + junk if k == lang]
        total = Counter()
        for t in own:
            total.update(brute_chars(t))
        assert all(abs(ref.chars[lang][k] - total[k] / sum(map(len, own))) < 1e-12 for k in total)
        words = Counter(w for t in own for w in t.lower().split())
        top = sorted(words.items(), key=lambda x: (-x[1], x[0]))[:R.TOP_WORDS]
        assert ref.words[lang] == {w: n / sum(n for _, n in top) for w, n in top}
    frequent = {w for r in ref.words.values() for w in r}
    for r in R.with_verdict(df, ref).collect():
        text = texts[r["doc_id"]]
        if len(text) < R.MIN_CHARS:
            assert r["char_distance"] is None
        else:
            n = brute_chars(text)
            want = min(distance({k: v / len(text) for k, v in n.items()}, c) for c in ref.chars.values())
            assert abs(r["char_distance"] - want) < 1e-9
        words = text.lower().split()
        if len(words) < R.MIN_WORDS:
            assert r["word_distance"] is None
        else:
            own = Counter(w for w in words if w in frequent)
            share = {w: k / sum(own.values()) for w, k in own.items()}
            want = min(distance(share, q) if share else 1.0 for q in ref.words.values())
            assert abs(r["word_distance"] - want) < 1e-9
    none = R.with_verdict(df.limit(0), R.fit_reference(df.limit(0)))
    assert none.count() == 0 and "kept" in none.columns
