import __spark_entry__ as entry
import corpus_pipeline as P

from candleflow.llm import mixing, pii, simhash_bk, spm_codec, toxicity
from candleflow.llm.pieces import load_pieces
from candleflow.llm.queries import toxic_model

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    columns = rows.columns
    toxic, dedup, redact, mix, tokens = [f for _, f in P.STAGES]

    kept = toxic(spark, rows, SF).cache()
    scores = toxicity.with_toxicity(rows, toxic_model(spark, rows, SF)).collect()
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in scores if r["score"] < 0.5)

    one = dedup(spark, kept, SF).cache()
    groups = {r["id"]: r["component"] for r in simhash_bk.near_duplicates(kept).collect()}
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(set(groups.values()))

    clean = redact(spark, one, SF).cache()
    texts = {r["doc_id"]: r["text"] for r in one.collect()}
    for r in pii.with_spans(one, None).collect():
        for x in r["base_spans"]:
            assert texts[r["doc_id"]][x["s"]:x["e"]] not in [r2["text"] for r2 in clean.collect()]
    assert clean.count() == one.count()
    left = [x for r in pii.with_spans(clean, None).collect() for x in r["base_spans"]]
    assert not left

    mixed = mix(spark, clean, SF).cache()
    words = {}
    for r in mixed.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].encode().split())
        assert r["n_chars"] == len(r["text"])
    assert words == {r["id"]: r["taken"] for r in mixing.mix_plan(clean).collect() if r["taken"]}
    for stage in (kept, one, clean, mixed):
        assert stage.columns == columns

    p = load_pieces()
    for r in tokens(spark, mixed, SF).collect():
        assert spm_codec.decode(r["ids"], p) == r["text"]


def test_stages_take_nulls_and_nothing(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, None), (None, "a@b.io " * 3, "en", "s", 21), (2, "x y z", None, "s", None),
         (2, "x y z", None, "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.limit(0)):
        for _, stage in P.STAGES:
            rows = stage(spark, rows, SF)
            rows.collect()


def test_registered(spark):
    names = set(entry.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in names}
    assert P.ORACLE_SQL is None and P.run.__code__.co_argcount == 2
