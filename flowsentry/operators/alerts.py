"""Time-to-alert, batch form (T3): first ground-truth attack, first
detection, their difference; one row per device."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.operators.windows import FEATURES


def time_to_alert(scored: DataFrame, ts: str = "ts", by: Sequence[str] = (),
                  features: Sequence[str] = FEATURES) -> DataFrame:
    """The label time is taken over every window; detections only over
    windows that are scored (not all-zero).  NULL until both exist; it is
    negative when a false positive came first."""
    nonzero = None
    for c in features:
        t = F.col(c) != 0
        nonzero = t if nonzero is None else nonzero | t
    g = scored.groupBy(*by).agg(
        F.min(F.when(F.col("label") == 1, F.col(ts))).alias("first_attack_label_ts"),
        F.min(F.when((F.col("pred") == 1) & nonzero, F.col(ts))).alias("first_detection_ts"))
    return g.withColumn("time_to_alert_seconds",
                        F.col("first_detection_ts") - F.col("first_attack_label_ts"))
