"""The forest of op10 learns from every labelled row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loxodrome.llm import quality_rules as qr


class AsGiven(qr.IsolationForest):
    def score(self, x, half=None):
        return x


@pytest.mark.parametrize("n_good, n_bad, places", [(300, 200, 3), (50, 0, 2), (1, 1, 1), (400, 300, 9)])
def test_limit_is_that_over_all_rows(spark, n_good, n_bad, places):
    rng = np.random.default_rng(n_good)
    good, bad = np.round(rng.uniform(0.3, 0.6, n_good), places), np.round(rng.uniform(0.4, 0.8, n_bad), places)
    rows = [(float(v), 1, 0) for v in good] + [(float(v), 0, 1) for v in bad]
    marks = spark.createDataFrame(rows, "anomaly double, good long, bad long").groupBy("anomaly").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    want = AsGiven().calibrate(good, bad).limit
    assert qr.best_limit(marks, n_good, 16) == pytest.approx(want, abs=1e-12) == qr.best_limit(marks, n_good)


def test_forest_sees_every_labelled_row(spark, monkeypatch):
    n = 9000  # of which 6000 are good: over the 2000 that were once taken
    texts = spark.range(n).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 12 + id % 9), i -> concat(repeat('x', 1 + (id * i) % 13), id % 17))) AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "CAST(id % 3 > 0 AS INT) AS quality")
    seen = {}

    def limit(marks, n_good, *rest):
        seen["marks"] = marks.agg(F.sum("good"), F.sum("bad")).first()
        return own(marks, n_good, *rest)

    own = qr.best_limit
    monkeypatch.setattr(qr, "best_limit", limit)
    forest = qr.fit_rule_forest(texts, labels)
    assert tuple(seen["marks"]) == (6000, 3000)
    assert len(forest.grown) == 100 and all(len(t[0]) > 1 for t in forest.grown)
    assert forest.limit == qr.fit_rule_forest(texts.repartition(7), labels).limit
