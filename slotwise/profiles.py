"""Run parameters bundled per data set.

``TRIPS_JAN_2025`` carries the original pipeline's defaults.  ``EVENTS`` maps
the driver's synthetic ``events`` table (one month, 2024-01) onto the same
pipeline: holidays, cutoffs and thresholds are moved to that month and the
value ranges to the ranges of ``events.value`` and ``props.k``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from slotwise import schemas as S
from slotwise.schemas import RangeRule


@dataclass(frozen=True)
class Profile:
    name: str
    rules: tuple[RangeRule, ...]
    holidays: tuple[str, ...]
    min_active_hours: int
    val_start: str
    test_start: str
    alt_val_start: str
    alt_val_end: str
    rush_hours: tuple[int, ...] = S.RUSH_HOURS
    seed: int = S.RANDOM_SEED
    folds: int = S.CV_FOLDS
    extra: dict = field(default_factory=dict)


TRIPS_JAN_2025 = Profile(
    name="trips_jan_2025",
    rules=S.TRIP_RULES,
    holidays=S.HOLIDAYS_JAN_2025,
    min_active_hours=S.MIN_ACTIVE_HOURS,
    val_start=S.VAL_START_2025,
    test_start=S.TEST_START_2025,
    alt_val_start=S.ALT_VAL_START_2025,
    alt_val_end=S.ALT_VAL_END_2025,
)

# events.value spans 0.01-490 and props.k 0-100, so the ranges are widened to
# (0, 200], [2.5, 200] and [1, 60].  After cleaning a zone (user) has a median
# of about 35 active hours at every scale factor, so the activity threshold is
# 36 hours, which keeps about half of the zones.  Test starts 2024-01-29 so the test split holds 48 hours.
EVENTS = Profile(
    name="events_jan_2024",
    rules=(
        RangeRule("trip_distance", 0.0, 200.0, lo_open=True),
        RangeRule("fare_amount", 2.5, 200.0),
        RangeRule("passenger_count", 1.0, 60.0),
    ),
    holidays=("2024-01-01", "2024-01-15"),
    min_active_hours=36,
    val_start="2024-01-22",
    test_start="2024-01-29",
    alt_val_start="2024-01-15",
    alt_val_end="2024-01-22",
)
