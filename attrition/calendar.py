"""Calendar and cost parameters shared by all operators.

Every date that the analyses compare against is a field here, so the same
operators run on the original retail calendar and on the test tables.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


@dataclass(frozen=True)
class ChurnCalendar:
    observation: dt.date            # feature cut-off and D1 churn cut
    prediction_end: dt.date         # end of the label window (obs + window)
    churn_window_days: int = 60
    min_history_days: int = 60
    home_country: str = "United Kingdom"
    # Bounds used by the out-of-range date check.
    valid_from: dt.date = dt.date(2009, 1, 1)
    valid_to: dt.date = dt.date(2011, 12, 31)

    @property
    def eligibility_cutoff(self) -> dt.date:
        """first purchase on or before this date -> enough history (obs - 60d)."""
        return self.observation - dt.timedelta(days=self.min_history_days)

    @property
    def dormant_cutoff(self) -> dt.date:
        """last purchase on or before this date -> dormant (obs - 61d)."""
        return self.observation - dt.timedelta(days=self.churn_window_days + 1)

    @property
    def acquisition_cutoff(self) -> dt.date:
        """first purchase on or before this date for seasonal cohorts (obs - 122d)."""
        return self.observation - dt.timedelta(days=2 * (self.churn_window_days + 1))

    @property
    def recent_cutoff(self) -> dt.date:
        """obs - 30d, start of the 'last 30 days' feature window."""
        return self.observation - dt.timedelta(days=30)


# Fixed values of the original analysis.
REFERENCE_CALENDAR = ChurnCalendar(
    observation=dt.date(2011, 10, 10),
    prediction_end=dt.date(2011, 12, 9),
    home_country="United Kingdom",
)

# The test tables end on 2001-08-01; the same 60-day geometry ends there.
TESTDATA_CALENDAR = ChurnCalendar(
    observation=dt.date(2001, 6, 2),
    prediction_end=dt.date(2001, 8, 1),
    home_country="NATION_0",
    valid_from=dt.date(1995, 1, 1),
    valid_to=dt.date(2001, 12, 31),
)


# Short-horizon calendar for the purchase events (January 2024, sub-second
# timestamps): a 5-day churn window keeps every cut-off inside the data.
EVENTS_CALENDAR = ChurnCalendar(
    observation=dt.date(2024, 1, 20),
    prediction_end=dt.date(2024, 1, 25),
    churn_window_days=5,
    min_history_days=5,
    home_country="NATION_0",
    valid_from=dt.date(2024, 1, 1),
    valid_to=dt.date(2024, 12, 31),
)


@dataclass(frozen=True)
class CostModel:
    # Fixed values of the original cost framework.
    cost_fn: float = 200.0          # missed churner
    cost_fp: float = 20.0           # false alarm
    cost_tp: float = -80.0          # caught churner (net gain)
    cost_tn: float = 0.0
    retention_success_rate: float = 0.40
    customer_lifetime_value: float = 200.0
    incentive_cost: float = 20.0
    # Annualisation: (scale factor, runs per year) of the two published formulas.
    annual_scale_factor: float = 5.0
    runs_per_year: float = 4.0


@dataclass(frozen=True)
class SegmentStrategy:
    segment: str
    action: str
    cost_per_customer: float
    expected_save_rate: float


# Risk thresholds and the per-segment retention strategy.
RISK_THRESHOLDS = ((0.7, "HIGH_RISK"), (0.4, "MEDIUM_RISK"), (0.2, "LOW_RISK"))
SAFE_SEGMENT = "SAFE"
SEGMENT_STRATEGIES = (
    SegmentStrategy("HIGH_RISK", "IMMEDIATE INTERVENTION", 50.0, 0.25),
    SegmentStrategy("MEDIUM_RISK", "PROACTIVE ENGAGEMENT", 20.0, 0.40),
    SegmentStrategy("LOW_RISK", "NURTURE & MONITOR", 5.0, 0.60),
    SegmentStrategy("SAFE", "MAINTAIN RELATIONSHIP", 2.0, 0.80),
)

# Stock codes that are services, not products.
SERVICE_CODES = ("POST", "D", "M", "BANK CHARGES", "PADS", "DOT", "CRUK", "C2", "AMAZONFEE")
