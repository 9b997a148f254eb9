"""Column contracts and fixed values shared by every stage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the values of the original forecasting
# pipeline for results to match; they are stated here together, in their
# natural order.
# ---------------------------------------------------------------------------
ZONE = "PULocationID"
PICKUP = "tpep_pickup_datetime"
DROPOFF = "tpep_dropoff_datetime"
HOUR = "hour"
TARGET = "demand"

FEATURE_COLS: list[str] = [
    "hour_of_day",
    "day_of_week",
    "is_weekend",
    "is_rush_hour",
    "is_holiday",
    "PULocationID",
    "demand_lag_1h",
    "demand_lag_24h",
    "demand_lag_168h",
    "demand_rolling_3h",
    "demand_rolling_168h",
]
LAG_HOURS: tuple[int, ...] = (1, 24, 168)
ROLLING_HOURS: tuple[int, ...] = (3, 168)
RUSH_HOURS: tuple[int, ...] = (7, 8, 17, 18)
EDA_RUSH_HOURS: tuple[int, ...] = (7, 8, 9, 17, 18, 19)
HOLIDAYS_JAN_2025: tuple[str, ...] = ("2025-01-01", "2025-01-20")
MIN_ACTIVE_HOURS = 100
VAL_START_2025 = "2025-01-22"
TEST_START_2025 = "2025-02-01"
ALT_VAL_START_2025 = "2025-01-15"
ALT_VAL_END_2025 = "2025-01-22"
RANDOM_SEED = 42
TEST_FRACTION = 0.20
VAL_FRACTION_OF_REST = 0.25
CV_FOLDS = 5
# error band shown next to every served prediction (validation MAE)
TUNED_VAL_MAE = 3.62
# distance (0, 50], fare [2.50, 200], passengers [1, 6]
CLEAN_DISTANCE = (0.0, 50.0)
CLEAN_FARE = (2.50, 200.0)
CLEAN_PASSENGERS = (1.0, 6.0)
# columns that go missing together in the raw trip file
JOINT_NULL_COLS: list[str] = [
    "Airport_fee",
    "passenger_count",
    "congestion_surcharge",
    "RatecodeID",
    "store_and_fwd_flag",
]
DROP_NULL_PCT = 30.0
DAY_NAMES: list[str] = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
# random-search space: trees 100..500 step 50, depth 5..30, leaf 1..20
SEARCH_TREES = (100, 500, 50)
SEARCH_DEPTH = (5, 30)
SEARCH_LEAF = (1, 20)
SEARCH_FEATURES: tuple[str, ...] = ("sqrt", "log2", "0.5")
SEARCH_TRIALS = 15
BASELINE_TREES = 100
TUNED_TREES = 350
TUNED_DEPTH = 30


@dataclass(frozen=True)
class RangeRule:
    """``lo < col`` (``lo_open``) or ``lo <= col``, and ``col <= hi``.

    A null (or NaN) value never satisfies a rule, matching the behaviour of
    chained comparisons on a float column with missing values.
    """

    col: str
    lo: float
    hi: float
    lo_open: bool = False
    name: str | None = None

    @property
    def label(self) -> str:
        lo = "(" if self.lo_open else "["
        return self.name or f"{self.col} {lo}{self.lo:g}, {self.hi:g}]"


TRIP_RULES: tuple[RangeRule, ...] = (
    RangeRule("trip_distance", CLEAN_DISTANCE[0], CLEAN_DISTANCE[1], lo_open=True),
    RangeRule("fare_amount", CLEAN_FARE[0], CLEAN_FARE[1]),
    RangeRule("passenger_count", CLEAN_PASSENGERS[0], CLEAN_PASSENGERS[1]),
)

# ---------------------------------------------------------------------------
# Physical schemas
# ---------------------------------------------------------------------------
TRIP_SCHEMA = T.StructType(
    [
        T.StructField("VendorID", T.IntegerType()),
        T.StructField(PICKUP, T.TimestampNTZType()),
        T.StructField(DROPOFF, T.TimestampNTZType()),
        T.StructField("passenger_count", T.DoubleType()),
        T.StructField("trip_distance", T.DoubleType()),
        T.StructField("RatecodeID", T.DoubleType()),
        T.StructField("store_and_fwd_flag", T.StringType()),
        T.StructField(ZONE, T.IntegerType()),
        T.StructField("DOLocationID", T.IntegerType()),
        T.StructField("payment_type", T.IntegerType()),
        T.StructField("fare_amount", T.DoubleType()),
        T.StructField("extra", T.DoubleType()),
        T.StructField("mta_tax", T.DoubleType()),
        T.StructField("tip_amount", T.DoubleType()),
        T.StructField("tolls_amount", T.DoubleType()),
        T.StructField("improvement_surcharge", T.DoubleType()),
        T.StructField("total_amount", T.DoubleType()),
        T.StructField("congestion_surcharge", T.DoubleType()),
        T.StructField("Airport_fee", T.DoubleType()),
        T.StructField("cbd_congestion_fee", T.DoubleType()),
    ]
)

ZONE_CSV_SCHEMA = T.StructType(
    [
        T.StructField("LocationID", T.IntegerType()),
        T.StructField("Zone", T.StringType()),
        T.StructField("Borough", T.StringType()),
    ]
)

PANEL_COLS: list[str] = [
    ZONE,
    HOUR,
    TARGET,
    "hour_of_day",
    "day_of_week",
    "is_weekend",
    "is_rush_hour",
    "is_holiday",
]

LOOKUP_COLS: list[str] = [
    ZONE,
    "hour_of_day",
    "day_of_week",
    "mean_demand",
    "mean_demand_lag_1h",
    "mean_demand_lag_24h",
    "mean_demand_lag_168h",
    "mean_demand_rolling_3h",
    "mean_demand_rolling_168h",
]

METRIC_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("fold", T.IntegerType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def assert_columns(df, required, stage: str) -> None:
    """Stage-boundary check: fail early with the missing column names."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{stage}: missing columns {missing}; have {df.columns}")
