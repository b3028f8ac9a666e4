import heapq
import random

import pytest

from candleflow.llm import mixing as M


def highest_quotients(votes, seats):
    """Sainte-Lague by the priority queue of its definition."""
    got = [0] * len(votes)
    queue = [(-v, i) for i, v in enumerate(votes)]
    heapq.heapify(queue)
    for _ in range(seats):
        _, i = heapq.heappop(queue)
        got[i] += 1
        heapq.heappush(queue, (-votes[i] / (2 * got[i] + 1), i))
    return got


def test_common_divisor_is_the_allocation_by_highest_quotients():
    rnd = random.Random(1)
    for _ in range(50):
        votes = [rnd.uniform(1, 5000) for _ in range(rnd.randint(1, 12))]
        seats = [int(v / 64 + 0.5) for v in votes]
        assert highest_quotients(votes, sum(seats)) == seats


def brute_targets(sizes, weights, cap=3):
    total, left = sum(sizes), set(range(len(sizes)))
    target = [0.0] * len(sizes)
    while left:
        rest = total - sum(target[i] for i in range(len(sizes)) if i not in left)
        share = {i: rest * weights[i] / sum(weights[j] for j in left) for i in left}
        over = {i for i in left if share[i] > cap * sizes[i]}
        if not over:
            for i in left:
                target[i] = share[i]
            break
        for i in over:
            target[i] = float(cap * sizes[i])
        left -= over
    return target


def test_plan(spark, docs):
    rnd = random.Random(4)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 300)), "en", rnd.choice(["a", "a", "b", "é", "B", None, "tiny"][:7]))
            for i in range(400)]
    rows += [(1000, " ".join(["long"] * 20_000), "en", "a"), (2007, None, "en", "a"), (2008, "", "en", "empty")]
    df = docs(rows + rows[:3], [("size", 1), ("target", "x"), ("taken", 0), ("_size", 5)])
    plan = [r.asDict() for r in M.mix_plan(df, block=16, shard_words=5_000).collect()]
    again = [r.asDict() for r in M.mix_plan(df.repartition(5), block=16, shard_words=5_000).collect()]
    key = lambda r: (r["id"], r["taken"], r["target"])
    assert sorted(map(key, plan)) == sorted(map(key, again)) and len(plan) == len(rows) + 3
    names = ["B", "a", "b", "empty", "tiny", "é", None]
    sizes = {n: 0 for n in names}
    for _, t, _, s in rows + rows[:3]:
        sizes[s] += len((t or "").split())
    want = brute_targets([sizes[n] for n in names], [M.WEIGHTS[i % 3] for i in range(7)])
    source = {i: s for i, _, _, s in rows}
    for n, target in zip(names, want):
        own = [r for r in plan if source[r["id"]] == n]
        assert all(r["target"] == pytest.approx(target) and r["source_size"] == sizes[n] for r in own)
        shards = sizes[n] // 5_000 + 1
        assert abs(sum(r["taken"] for r in own) - target) <= 16 * shards
    for r in plan:
        words = sum(p["stop"] - p["start"] for p in r["ranges"])
        assert r["taken"] == r["passes"] * r["size"] + words <= 3 * r["size"]
        assert all(0 <= p["start"] < p["stop"] <= r["size"] for p in r["ranges"])


def test_documents_of_the_mix(spark, docs):
    df = docs([(i, f"a{i}  b c\nd e{i}", "en", f"s{i % 4}") for i in range(80)] + [(99, None)], [("_id", 1)])
    mix = M.mix_documents(df, block=3)
    assert mix.columns == df.columns
    words = {}
    for r in mix.collect():
        assert r["n_chars"] == len(r["text"])
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    taken = {r["id"]: r["taken"] for r in M.mix_plan(df, block=3).collect() if r["taken"]}
    assert words == taken
    assert M.mix_plan(df.limit(0)).count() == 0 and M.mix_documents(df.limit(0)).count() == 0


def test_cut_words_keeps_the_text_between():
    assert M.cut_words("a  b\tc d", [(0, 2), (3, 4)]) == "a  b\nd"
