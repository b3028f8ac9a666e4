import random

import pytest
import xxhash

from candleflow.llm import simhash_bk as S
from candleflow.llm.components import stars


def brute_fingerprint(text, k=4):
    words = text.encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, bits):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_fingerprint_equals_brute_force():
    rnd = random.Random(1)
    for n in (0, 1, 3, 4, 5, 60):
        t = " ".join(rnd.choice(["Aa", "bÉ", "ccc", "d d"]) for _ in range(n))
        assert S.fingerprint(t.encode()) & (1 << 64) - 1 == brute_fingerprint(t)


def test_bk_tree_finds_all_within_radius():
    rnd = random.Random(2)
    values = [rnd.getrandbits(12) for _ in range(200)]
    tree = S.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:40]:
        assert sorted(tree.within(q, 3)) == sorted(v for v in values if (v ^ q).bit_count() <= 3)


@pytest.mark.parametrize("chunk", [3, 1000])
def test_links_are_complete_for_dense_and_hot_shards(spark, chunk):
    rnd = random.Random(3)
    base = rnd.getrandbits(64)
    fps = {base, 0, (1 << 64) - 1}
    for _ in range(60):  # a crowd around one value, in every shard of it
        v = base
        for b in rnd.sample(range(64), rnd.randint(0, 5)):
            v ^= 1 << b
        fps.add(v)
    fps |= {rnd.getrandbits(64) for _ in range(60)}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    frame = spark.createDataFrame([(signed(v),) for v in fps], "fp long").repartition(3)
    found = {r["a"]: r["b"] for r in stars(S.fingerprint_links(frame, 4, chunk)).collect()}
    want = components(fps, 4)
    groups = {}
    for v in fps:
        groups.setdefault(want[v], set()).add(found.get(signed(v), signed(v)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_defined_cases(spark, docs):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, long), (3, long.replace("w29999", "x")), (9, None), (4, ""), (7, " \n"), (8, "Solo"), (8, "solo"),
            (None, "solo"), (2, "other words are here now")]
    df = docs(rows, [("fp", 1), ("grp", "x"), ("component", 0), ("id", 1), ("least", 3)])
    got = [(r["id"], r["component"]) for r in S.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(5, 3), (3, 3), (9, 4), (4, 4), (7, 4), (8, 8), (8, 8), (None, 8), (2, 2)],
                                          key=str)
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 8]
    assert S.near_duplicates(df.limit(0)).count() == 0 and S.keep_one(df.limit(0)).count() == 0
