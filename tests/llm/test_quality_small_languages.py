"""Languages under one per cent: found without or with a wrong ``lang``, and the
same distances in SQL."""

import duckdb
import pytest

from candleflow.llm import quality_rules as R
from candleflow.llm.oracle import SQL
from candleflow.llm.queries import op8_quality_rules
from tests.llm.test_quality_languages import LARGE, SMALL, TINY, prose

OTHER = ["träd", "eld", "sol", "an", "muir", "sjö", "hus", "fågel", "och", "att", "kulle", "himmel"]


def rows():
    out = [(i, prose(LARGE, 30_000, i), "en", "s") for i in range(20)]
    out += [(100 + i, prose(SMALL, 150, i), "ga", "s") for i in range(20)]
    out += [(150 + i, prose(OTHER, 160, i), "sv", "s") for i in range(20)]
    out += [(300 + i, prose(SMALL, 150, 50 + i), None, "s") for i in range(12)]  # untagged
    out += [(400 + i, prose(SMALL if i % 2 else OTHER, 150, 80 + i), "en", "s") for i in range(4)]  # mis-tagged
    out += [(500, prose(TINY, 150, 1), "fi", "s"), (501, prose(TINY, 150, 1), None, "s"), (502, prose(TINY, 150, 2), "ga", "s"),
            (503, prose(SMALL, 60, 2), None, "s"), (504, "#%@ " * 120, None, "s"), (505, None, None, None), (506, "", "ga", "s")]
    return out


@pytest.mark.parametrize("at_once", [5_000, 1])
def test_untagged_and_mis_tagged_documents_are_kept(spark, docs, monkeypatch, at_once):
    df = docs(rows())
    ref = R.fit_reference(df)
    monkeypatch.setattr(R, "BROADCAST_LANGS", at_once)
    assert list(ref.chars) == ["en"] and ref.n_small == 2
    got = {r["doc_id"]: r for r in R.with_verdict(df, ref).collect()}
    assert len(got) == len(rows())
    for i in [*range(100, 120), *range(150, 170), *range(300, 312), *range(400, 404)]:
        assert got[i]["kept"] and got[i]["word_distance"] < 0.5, i
    assert got[500]["kept"] and got[500]["word_distance"] is None  # no usable reference: silent
    assert not got[501]["kept"] and not got[502]["kept"] and not got[504]["kept"]
    assert got[503]["kept"] and got[503]["word_distance"] is None


def test_sql_has_the_same_path(spark, docs, tmp_path):
    df = docs(rows() + [(600 + i, prose([f"x{i}y{k}" for k in range(9)], 700, i), f"l{i}", "s") for i in range(3)])
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r.asDict() for r in op8_quality_rules(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(SQL["op8_quality_rules"]).df()
    assert len(want) == len(got)
    for r in want.to_dict("records"):
        mine = got[r["doc_id"]]
        for k, v in r.items():
            if isinstance(v, float):
                assert (mine[k] is None) == (v != v) and (v != v or abs(mine[k] - v) < 2e-6), (r["doc_id"], k)
            else:
                assert mine[k] == v, (r["doc_id"], k)
