"""attrition: customer-retention analytics as Spark DataFrame operators.

Every public operator is a function ``(DataFrame, ...) -> DataFrame`` built
from native Spark SQL expressions, so Catalyst can prune, push down and plan
the work; nothing is collected to the driver except results whose size is
bounded by a constant (thresholds, bucket tables, metric rows).
"""

from attrition.calendar import ChurnCalendar, CostModel, REFERENCE_CALENDAR, TESTDATA_CALENDAR
from attrition.session import get_session, checkpoint_dir

__all__ = [
    "ChurnCalendar",
    "CostModel",
    "REFERENCE_CALENDAR",
    "TESTDATA_CALENDAR",
    "get_session",
    "checkpoint_dir",
]
