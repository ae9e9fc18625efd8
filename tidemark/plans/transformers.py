"""MLlib stages of this library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Transformer
from pyspark.sql import DataFrame

from tidemark.operators.eventstream import drop_empty, mean_and_variance


class FlatFeatureModel(Transformer):
    def __init__(self, dropped: Sequence[str] = ()):
        super().__init__()
        self.dropped = list(dropped)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return mean_and_variance(dataset).drop(*self.dropped)


class FlatFeatureSelector(Estimator):
    """Fit finds the columns that are null on every row; transform turns sums into means and variances and drops those."""

    def __init__(self, keep: Sequence[str] = ()):
        super().__init__()
        self.keep = list(keep)

    def _fit(self, dataset: DataFrame) -> FlatFeatureModel:
        wide = mean_and_variance(dataset)
        left = drop_empty(wide, self.keep).columns
        return FlatFeatureModel([c for c in wide.columns if c not in left])
