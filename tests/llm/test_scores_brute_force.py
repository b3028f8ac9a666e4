"""Scores of the quality classifier and of the language model, worked out again
from their definitions."""

import math
from collections import Counter
from zlib import crc32

import pytest

from candleflow.llm import brown_lm as B
from candleflow.llm import quality_zstd as Z


def test_quality_score_from_compressed_sizes(spark, docs):
    import zstandard

    good, bad = b"the house stands by the sea and the hill " * 40, b"buy now cheap cheap click here free " * 40
    weights = [0.1] + [0.03 * (i % 7 - 3) for i in range(3 * Z.FEATURES - 1)]
    mean, scale = [0.05, 0.0, -1.0, -1.2, -0.8, 5.0], [0.2, 0.3, 1.0, 1.1, 0.9, 2.0]
    model = Z.QualityModel(good, bad, mean, scale, weights)
    texts = [None, "", "the house stands", "buy now cheap é click here", "mixed words " * 900, "x" * 5000]

    def size(content, chunk):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=Z.LEVEL)
        return len(zstandard.ZstdCompressor(level=Z.LEVEL, dict_data=d, write_content_size=False, write_checksum=False,
                                            write_dict_id=False).compress(chunk))

    def expected(text):
        raw = (text or "").encode()
        chunks = [raw[i:i + Z.CHUNK] for i in range(0, max(1, len(raw)), Z.CHUNK)]
        g, b = [size(good, c) for c in chunks], [size(bad, c) for c in chunks]
        rates = [math.log(min(x, y) / max(1, len(c))) for x, y, c in zip(g, b, chunks)]
        f = [(sum(b) - sum(g)) / (sum(b) + sum(g)), min(1.0, *[(y - x) / (y + x) for x, y in zip(g, b)]), min(rates),
             sum(r * max(1, len(c)) for r, c in zip(rates, chunks)) / max(1, len(raw)), max(rates), math.log(len(raw) + 1)]
        z = [min(6.0, max(-6.0, (v - m) / s)) for v, m, s in zip(f, mean, scale)]
        terms = z + [v * v for v in z] + [v * z[-1] for v in z[:-1]]
        return 1 / (1 + math.exp(-(weights[0] + sum(w * t for w, t in zip(weights[1:], terms)))))

    got = {r["doc_id"]: r["score"] for r in Z.with_quality(docs(list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(expected(t), rel=1e-9), t and t[:20]


def test_class_score_from_the_models_own_classes(spark, docs, monkeypatch):
    import random

    monkeypatch.setattr(B, "CLASSES", 6)
    monkeypatch.setattr(B, "OWN_UNIT", 0.004)
    rnd = random.Random(3)
    nouns, verbs = ["tree", "house", "bird", "hill"], ["sees", "moves", "finds"]
    texts = [" ".join(w for _ in range(rnd.randint(1, 9)) for w in (
        "the", rnd.choice(nouns), rnd.choice(verbs), f"rare{rnd.randint(0, 60)}")) for _ in range(150)] + ["", None, "The  TREE\nsees"]
    df = docs(list(enumerate(texts)))
    model, _, _ = B.fit_and_encode(df)
    tokens = {i: (t or "").lower().encode().split() for i, t in enumerate(texts)}
    training = [i for i in tokens if crc32(str(i).encode()) % B.FOLDS]
    count = Counter(w for i in training for w in tokens[i])
    own = {w: model.words.unit[k] for w, k in model.words.index.items()}
    unit = lambda w: own.get(w, 1 + B._ending(w))
    path = {i: [0, *[model.classes[unit(w)] for w in ws], 0] for i, ws in tokens.items()}
    assert model.classes[0] == 0 and len(set(model.classes)) > 2
    pairs, before, into = Counter(), Counter(), Counter()
    for i in training:
        for a, b in zip(path[i], path[i][1:]):
            pairs[a, b] += 1
            before[a] += 1
            into[b] += 1
    types = Counter({0: 1})
    for w in count:
        types[model.classes[unit(w)]] += 1
    total, k = sum(into.values()), len(model.log_size)
    prior = lambda c: (into[c] + B.DELTA) / (total + B.DELTA * k)

    def step(a, b):
        return math.log10((pairs[a, b] + B.KAPPA * prior(b)) / (before[a] + B.KAPPA)) \
            - math.log10(into[b] + B.DELTA * (types[b] + 1))

    got = {r["id"]: r["score"] for r in B.score_documents(df).collect()}
    for i, ws in tokens.items():
        want = sum(step(a, b) for a, b in zip(path[i], path[i][1:]))
        want += sum(math.log10(count[w] + B.DELTA) for w in ws) + math.log10(len(training) + B.DELTA)
        assert got[i] == pytest.approx(want, rel=1e-9), i
