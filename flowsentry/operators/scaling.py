"""z-score scaler (M1): population std, a constant column keeps scale 1.

Fit is one aggregate (a row of means and stds); transform joins that row
as a broadcast.  Parameters never hold data, only 2 numbers per feature.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.operators.windows import FEATURES


class ZScaler:
    def __init__(self, features: Sequence[str] = FEATURES, prefix: str = "z_"):
        self.features = list(features)
        self.prefix = prefix
        self.params: DataFrame | None = None

    def fit(self, df: DataFrame) -> "ZScaler":
        aggs = []
        for c in self.features:
            x = F.col(c).cast("double")
            aggs += [F.avg(x).alias(f"_mu_{c}"), F.stddev_pop(x).alias(f"_sd_{c}")]
        self.params = df.agg(*aggs)
        return self

    def transform(self, df: DataFrame, replace: bool = False) -> DataFrame:
        assert self.params is not None, "fit first"
        j = df.crossJoin(F.broadcast(self.params))
        for c in self.features:
            sd = F.col(f"_sd_{c}")
            scale = F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd)
            out = c if replace else f"{self.prefix}{c}"
            j = j.withColumn(out, (F.col(c).cast("double") - F.col(f"_mu_{c}")) / scale)
        return j.drop(*[f"_mu_{c}" for c in self.features], *[f"_sd_{c}" for c in self.features])

    def as_dict(self) -> dict:
        """The fitted parameters (one small row) as a dict, for persistence."""
        row = self.params.first().asDict()
        return {c: (row[f"_mu_{c}"], row[f"_sd_{c}"]) for c in self.features}
