"""Tables of a worker are dropped at the end of a task, and ids stay the same."""

from candleflow.llm.pieces import load_pieces
from candleflow.llm.spm_codec import Encoder, with_ids


def test_forgotten_tables_are_found_again():
    p = load_pieces()
    enc, texts = Encoder(p), ["One, two  three.\nHäuser 12 日本", "", None, "one two One, two"]
    first = enc.packed(texts)
    assert p.known and p.nodes
    p.forget()
    assert not (p.known or p.older or p.stable or p.nodes)
    assert enc.packed(texts) == first


def test_tasks_of_one_worker(spark):
    rows = [(i, f"word{i % 7} Häuser{i % 5}, {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "i long, text string").repartition(12)
    enc = Encoder(load_pieces())
    got = {r["i"]: r["ids"] for r in with_ids(df).collect()}
    assert got == {i: enc.encode(t) for i, t in rows}
