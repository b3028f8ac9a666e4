import glob
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from candleflow.llm import token_orc as T
from tests.llm.conftest import SF

ODD = ["", None, " ", "  two  spaces ", "a\nb", "a \n b", "tab\t x", "don't I'll we've 's", "  no-break  x",
       "é à ü  ß", "日本語 テキスト 。", "x\x1c y\x85 z", " lead", "trail ", "1 2  3 a1 2b", "<|endoftext|> a<|endoftext|>b",
       "é combining ́ alone", "🙂 🙂🙂  🙂", "a" * 5000, "word " * 3000, "​ ​ x 　 y   z",
       "! ! !! ?", "\n\n\n", "a  ", "  a"]


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(T.tokenizer_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_units_give_the_ids_of_the_whole_text(spark):
    encode, mine = library(), T.Encoder(T.tokenizer_path())
    texts = [t or "" for t in ODD] + [r["text"] or "" for r in
                                      spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for t, got in zip(texts, mine.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == encode(t), t[:80]


def test_random_texts():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    encode, mine = library(), T.Encoder(T.tokenizer_path())

    @settings(max_examples=400, deadline=None)
    @given(st.text(st.sampled_from("ab é'st1 \n\t 　\x1c!.日🙂́ "), max_size=30))
    def same(text):
        assert np.frombuffer(mine.encode([text])[0], "<u4").tolist() == encode(text)

    same()


def expected(rows):
    encode, out, start = library(), [], 0
    for i, t in rows:
        ids = [*encode(t), 0]
        out.append((i, start, len(ids), crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def read(spark, path):
    return [tuple(r) for r in T.with_crc32(T.read_tokens(spark, path)).select(
        "doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]


def test_query(spark):
    from candleflow.llm.queries import QUERIES

    got = QUERIES["op12_token_orc"](spark, SF).orderBy("doc_id").collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == expected(docs)


def test_files_order_and_edge_cases(spark, docs):
    rows = [(i * 7 % 25 - 5, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, "again"), (3, "again")]
    df = docs(rows, extra=[("shard", 1), ("offset", 2), ("t", "x"), ("ids", 3), ("first", 9)])
    path = T.write_tokens(df.repartition(5), shard_bytes=3000)
    assert len(glob.glob(f"{path}/*.orc")) > 5
    got, n = read(spark, path), {}
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: -99 if i is None else i)
    ends = np.cumsum([r[2] for r in got])
    assert [r[1] for r in got] == [0, *ends[:-1].tolist()]
    for i, t in rows:
        n.setdefault(i, []).append(expected([(i, t)])[0][2:])
    for r in got:
        n[r[0]].remove((r[2], r[3]))
    empty = T.write_tokens(docs([]))
    assert read(spark, empty) == []


def test_one_id_for_half_of_all_rows_is_cut(spark, docs):
    df = docs([(1, f"text number {i}") for i in range(3000)] + [(i, "x") for i in range(2, 3000)])
    path = T.write_tokens(df, shard_bytes=5000)
    sizes = [r["count"] for r in spark.read.orc(path).groupBy("shard").count().collect()]
    assert max(sizes) < 3 * sum(sizes) / len(sizes)
    assert sum(r[2] for r in read(spark, path)) == sum(r[2] for r in expected(
        df.select("doc_id", "text").collect()))


def test_search_by_id_is_pushed_down(spark, docs):
    from pyarrow import orc

    df = docs([(i * 2, f"text number {i}") for i in range(5000)])
    path = T.write_tokens(df, shard_bytes=20_000)
    found = T.find_documents(spark, path, [4000, 4001, 9998])
    assert sorted(r["doc_id"] for r in found.collect()) == [4000, 9998]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan
    name = sorted(glob.glob(f"{path}/*.orc"))[0]
    assert orc.ORCFile(name).nstripes >= 1
    # the stripe footer of a file with Bloom filters holds their streams: the same rows without them are smaller
    plain = f"{path}-plain"
    spark.read.orc(path).coalesce(1).write.option("compression", "zstd").orc(plain)
    size = lambda p: sum(len(open(f, "rb").read()) for f in glob.glob(f"{p}/*.orc"))
    again = f"{path}-bloom"
    spark.read.orc(path).coalesce(1).write.option("compression", "zstd") \
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(again)
    assert size(again) > size(plain)
    assert found.agg(F.count("*")).first()[0] == 2
