import random

from candleflow.llm import pii


def test_a_rare_kind_beside_a_dominant_one_gets_its_threshold(spark, docs):
    rnd = random.Random(5)
    part = lambda lo, hi: rnd.randint(lo, hi)
    rows = []
    for i in range(400):
        if i % 2:
            rows.append((i, f"please call me +1 ({part(200, 999)}) 555-{part(1000, 9999)} soon"))
        else:
            rows.append((i, f"part no={part(200, 999)}-{part(100, 999)}-{part(1000, 9999)}x in stock"))
    rows += [(1000 + i, " ".join(f"10.{part(0, 255)}.{part(0, 255)}.{part(0, 300)}" for _ in range(60)))
             for i in range(400)]
    model = pii.fit_pii(docs(rows), sample=1000)
    assert pii.KINDS.index("phone") in model.thresholds
    new = docs([(1, "please call me (443) 555-5793 soon"), (2, "part no=443-555-5793x in stock")])
    got = {r["doc_id"]: r for r in pii.with_spans(new, model).collect()}
    assert [(x["s"], x["e"]) for x in got[1]["spans"]] == [(15, 29)] and not got[2]["spans"]
