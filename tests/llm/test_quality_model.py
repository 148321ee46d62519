import zlib

import numpy as np
import pytest
from helpers import documents, prose
from pyspark.sql import functions as F

from archspan.llm import quality_model


def test_lasso_keeps_the_rule_that_matters():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 2] <= 0.1)).astype(float)
    model = quality_model.fit_matrix(x, y, list("abcd"))
    assert ((model.predict(x) >= 0.5) == (y == 1)).mean() > 0.98
    assert len(model.rules) < 80


@pytest.fixture(scope="module")
def rows():
    import random

    rng = random.Random(8)
    out = []
    for i in range(400):
        good = i % 3 > 0
        text = prose(rng, 60) if good else " ".join(f"{w}&&&" for w in prose(rng, 60).split())
        out.append((i, text, "en", "s", 1))
    return out


def test_held_out_accuracy_and_column_equals_numpy(spark, rows):
    df = documents(spark, rows, clash=("SCORE", "n_words", "f_n_words"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1] + [(1, None), (None, 1)], "doc_id long, label int")
    model = quality_model.fit(df, labels)
    got = quality_model.scored(df, model).collect()
    assert len(got) == 400
    out = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in out]) > 0.97
    names = [f"f_{n}" for n in model.names]
    x = np.array([list(r) for r in quality_model.with_features(documents(spark, rows)).orderBy("doc_id").select(*names).collect()])
    assert [r["score"] for r in sorted(got, key=lambda r: r["doc_id"])] == pytest.approx(model.predict(x).tolist())


def test_awkward_rows_have_scores(spark, rows):
    model = quality_model.fit(documents(spark, rows), spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)], "doc_id long, label int"))
    df = documents(spark)
    got = quality_model.scored(df, model)
    assert got.count() == df.count()
    assert got.filter(F.col("score").isNull() | F.isnan("score") | (F.col("score") < 0) | (F.col("score") > 1)).count() == 0


def test_no_labels_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, label int")
    model = quality_model.fit(documents(spark), none)
    assert {r["score"] for r in quality_model.scored(documents(spark), model).collect()} == {0.5}
    assert quality_model.scored(documents(spark, []), model).collect() == []
