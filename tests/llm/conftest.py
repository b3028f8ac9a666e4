import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture()
def docs(spark):
    """Builds a documents frame from (id, text) or (id, text, lang, source)."""
    def build(rows, extra=()):
        full = [(i, t, *(more or ("en", "s")), None if t is None else len(t)) for i, t, *more in rows]
        df = spark.createDataFrame([tuple(r) for r in full], DOCS)
        for name, value in extra:
            from pyspark.sql import functions as F
            df = df.withColumn(name, F.lit(value))
        return df
    return build


def by_id(rows, key="id"):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out
