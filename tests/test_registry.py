import numpy as np
import pytest
from oracle import FOLDER, compare

import __spark_entry__
from thawline.jobs import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_agree_with_sql(spark, name):
    compare(spark, registry.QUERIES[name], registry.ORACLES[name])


def test_fitted_scales_are_within_bounds(spark):
    got = registry.QUERIES["fit_timescales"](spark, FOLDER).toPandas()
    assert len(got) and (got.tau > 0).all() and (got.tau <= got.tau_max * (1 + 1e-12)).all() and (got.cost >= 0).all()


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"fit_timescales", "model_prediction"}


def test_models_of_fitted_scales_predict_a_scenario(spark):
    got = registry.QUERIES["model_prediction"](spark, FOLDER).toPandas()
    assert set(got.variable) == {"tas", "pr"} and got.groupby(["variable", "cell"]).time.nunique().min() == got.time.nunique() > 50
    assert np.isfinite(got.value).all()
