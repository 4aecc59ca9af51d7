"""op2's trees are fitted and calibrated on all rows of a table, with the results of the fit in memory."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from epsgrid.llm import pii


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 40, size=(9000, len(pii.NUMERIC))).astype(float)
    x[:, 0] = rng.integers(0, 4, size=len(x))
    return x, ((x[:, 1] + x[:, 2] > 45) | (x[:, 3] > 37)).astype(float)


def test_fit_on_a_table_equals_fit_in_memory(spark, rows):
    x, y = rows
    df = spark.createDataFrame([(int(b), *map(float, a)) for a, b in zip(x, y)], ["e", *[f"f_{c}" for c in pii.NUMERIC]])
    mem, tab = pii.Trees().fit(x, y, rounds=4), pii.Trees().fit_table(df, rounds=4)
    flat = lambda t: [v for f, cut, *leaves in t.trees for v in (f, cut, *leaves[0], *leaves[1])]
    assert tab.trees and np.allclose(flat(mem), flat(tab))
    tab.calibrate(x, y, 0.9)
    found, tab.threshold = tab.threshold, {}
    assert found and tab.calibrate_table(df, 0.9).threshold == pytest.approx(found)


def test_every_candidate_counts(spark, make_docs):
    docs = make_docs([(i, f"code {i:05d} 12 345 678 and") for i in range(8000)])
    seen = []
    fit, calibrate = pii.Trees.fit_table, pii.Trees.calibrate_table
    with pytest.MonkeyPatch.context() as m:
        m.setattr(pii.Trees, "fit_table", lambda s, r, **k: seen.append(r.count()) or fit(s, r, rounds=1))
        m.setattr(pii.Trees, "calibrate_table", lambda s, r, *a: seen.append(r.count()) or calibrate(s, r, *a))
        found = pii.candidates(docs).checkpoint()
        pii.train(found)
    assert sum(seen) == found.where(~F.col("base") & F.col("m").isNotNull()).count() >= 8000
