from candleflow.llm import mixing as M


def test_sources_smaller_than_a_block_reach_their_targets(spark, docs):
    rows = [(0, " ".join(["w"] * 40_000), "en", "big")]
    rows += [(1 + i, " ".join(["w"] * (5 + i)), "en", f"domain{i:03d}") for i in range(120)]
    df = docs(rows)
    plan = M.mix_plan(df).collect()
    assert len(plan) == len(rows)
    for r in plan:  # one document a source
        assert abs(r["taken"] - r["target"]) <= 0.5 and 0 < r["taken"] <= 3 * r["size"]
        assert r["taken"] == r["passes"] * r["size"] + sum(p["stop"] - p["start"] for p in r["ranges"])
    assert {r["size"]: r["taken"] for r in plan}[100] == 300
    words = {}
    for r in M.mix_documents(df).collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert words == {r["id"]: r["taken"] for r in plan}


def test_shards_of_a_source_add_up_to_its_target(spark, docs):
    df = docs([(i, " ".join(["w"] * 37), "en", "ab"[i % 2]) for i in range(300)])
    plan = M.mix_plan(df, shard_words=1_000).collect()
    for parity in (0, 1):
        own = [r for r in plan if r["id"] % 2 == parity]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 6  # 6 shards, half a word each
