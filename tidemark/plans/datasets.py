"""Datasets with what was fitted on them: saved once, loaded and applied to other tables later."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import eventstream as ES
from tidemark.plans import fitting
from tidemark.sources import io


@dataclass
class Dataset:
    """``tables``: subjects, events, measurements; ``numeric`` and ``vocabularies``: fitted tables by the name of their measure."""

    tables: Mapping[str, DataFrame]
    measures: Sequence[ES.Measurement]
    numeric: Mapping[str, DataFrame] = field(default_factory=dict)
    vocabularies: Mapping[str, DataFrame] = field(default_factory=dict)

    def fit(self, train: DataFrame | Mapping[str, DataFrame], min_key: float = 1, outlier_c: float | None = 5.0, **cutoffs) -> Dataset:
        """Fit all measures on the train split: its subjects, events and measurements, or its measurements alone. Measures that are
        dropped (see ``fitting.Fitted``) are left out of the result."""
        parts = {"measurements": train} if isinstance(train, DataFrame) else train
        fitted = fitting.fit_measures(parts, self.measures, min_key=min_key, outlier_c=outlier_c, **cutoffs)
        kept = {r["measure"] for r in fitted.status.filter(F.col("status") == fitting.KEPT).select("measure").collect()}  # a row for each measure
        known = {r["measure"] for r in fitted.vocabulary.select("measure").distinct().collect()}
        own = lambda df, m: df.filter(F.col("measure") == m.name).drop("measure")
        measures = [m for m in self.measures if m.name in kept]
        numeric = {m.name: own(fitted.numeric, m) for m in measures if m.modality.endswith("regression")}
        vocabularies = {m.name: fitted.vocabulary.filter(F.col("measure") == m.name) for m in measures if m.name in known}
        return Dataset(self.tables, measures, numeric, vocabularies)

    def transform(self, rows: DataFrame) -> DataFrame:
        """Apply what was fitted to the measures whose columns ``rows`` has: measurements, subjects or events. A single value
        that is a category moves to ``<name>_element``."""
        for m in self.measures:
            if m.name not in rows.columns:
                continue
            key, value = m.name, m.values_column
            if m.modality == "univariate_regression":
                key, value = f"{m.name}_element", m.name
                rows = rows.withColumn(key, F.when(F.col(m.name).isNotNull(), m.name))
            if m.name in self.numeric:
                rows = ES.transform_numeric(rows, key, value, self.numeric[m.name])
            if m.name in self.vocabularies:
                rows = ES.transform_categorical(rows, key, self.vocabularies[m.name], value)
            elif key != m.name:
                rows = rows.drop(key)
        return rows

    def save(self, path: str, overwrite: bool = False) -> None:
        parts = [("table", self.tables), ("numeric", self.numeric), ("vocabulary", self.vocabularies)]
        io.save_tables(path, {f"{kind}={name}": df for kind, group in parts for name, df in group.items()}, {"measures": [asdict(m) for m in self.measures]}, overwrite)


def load(spark: SparkSession, path: str) -> Dataset:
    tables, config = io.load_tables(spark, path)
    of = lambda kind: {k.partition("=")[2]: v for k, v in tables.items() if k.startswith(f"{kind}=")}
    return Dataset(of("table"), [ES.Measurement(**m) for m in config["measures"]], of("numeric"), of("vocabulary"))
