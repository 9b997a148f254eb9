"""The Spark feature table equals a single-process pandas statement of the
same pipeline (shift / rolling(min_periods=1) / groupby-transform mean)."""

import numpy as np
import pandas as pd

from slotwise.plans import common as C
from slotwise.session import configure
from tests.conftest import SF01


def test_features_equal_pandas(spark):
    import importlib.util
    import os

    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts", "pandas_baseline.py")
    spec = importlib.util.spec_from_file_location("pandas_baseline", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    expected = mod.build(pd.read_parquet(f"{SF01}/events.parquet"))
    configure(spark)
    got = C.features(spark, SF01).toPandas()
    key = ["PULocationID", "hour"]
    expected = expected.sort_values(key).reset_index(drop=True)
    got = got.sort_values(key).reset_index(drop=True)
    assert len(got) == len(expected)
    assert (got["PULocationID"].to_numpy() == expected["PULocationID"].to_numpy()).all()
    assert (pd.to_datetime(got["hour"]).to_numpy() == expected["hour"].to_numpy()).all()
    for c in ["demand", "hour_of_day", "day_of_week", "is_weekend", "is_rush_hour", "is_holiday"]:
        assert (got[c].to_numpy() == expected[c].to_numpy()).all(), c
    for c in ["demand_lag_1h", "demand_lag_24h", "demand_lag_168h", "demand_rolling_3h", "demand_rolling_168h"]:
        assert np.allclose(got[c].to_numpy(float), expected[c].to_numpy(float), atol=1e-9), c
