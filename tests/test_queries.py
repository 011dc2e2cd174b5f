"""Every registered query of the integration operators against its SQL on the smallest tables."""

import duckdb
import pytest

from knitwork.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return connection


def rows(frame):
    frame = frame[sorted(frame.columns)]
    show = lambda v: "null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_match_model_is_the_penalised_fit(spark):
    """The same logistic regression by Newton's method: z-scores, half the squared weights."""
    import numpy as np

    from knitwork.operators import matching

    got = matching.match_model(registry.labelled_pairs(spark, SF)).toPandas()
    train = got[(got.split == "train") & got.label.notna()]
    assert set(got.model_status) == {"trained"} and train.label.nunique() == 2
    x, y = train[list(matching.FEATURES)].to_numpy(float), train.label.to_numpy(float)
    mean, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    design = lambda m: np.c_[np.ones(len(m)), (m - mean) / scale]
    a, w, ridge = design(x), np.zeros(x.shape[1] + 1), np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-a @ w))
        w += np.linalg.solve((a.T * (p * (1 - p))) @ a + ridge, a.T @ (y - p) - ridge @ w)
    p = 1 / (1 + np.exp(-design(got[list(matching.FEATURES)].to_numpy(float)) @ w))
    assert np.abs(got.match_probability - (0.8 * p + 0.2 * got.rule_score)).max() < 2e-3
