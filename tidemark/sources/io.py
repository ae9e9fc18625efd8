"""Reading and writing tables."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.scalars import portable_hash
from tidemark.operators.filters import pick_columns


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Files, globs or folders; filters and column choice reach the scan."""
    return spark.read.parquet(*paths)


def read_csv(spark: SparkSession, *paths: str, schema: str | None = None) -> DataFrame:
    """With header; an empty field is null."""
    r = spark.read.option("header", True).option("nullValue", "").option("emptyValue", "")
    return (r.schema(schema) if schema else r).csv(list(paths))


def from_rows(spark: SparkSession, data, schema=None) -> DataFrame:
    """A table given as a DataFrame, a pandas frame or rows."""
    return data if isinstance(data, DataFrame) else spark.createDataFrame(data, schema)


@dataclass(frozen=True)
class Query:
    """A database query, read in ``partition_num`` ranges of a numeric column. The text may be in a file."""

    url: str
    query: str | None = None
    query_path: str | None = None
    partition_on: str | None = None
    bounds: tuple[int, int] | None = None
    partition_num: int = 1
    properties: tuple[tuple[str, str], ...] = ()

    def text(self) -> str:
        if (self.query is None) == (self.query_path is None):
            raise ValueError("give the query or the path of a file that holds it")
        if self.query is not None:
            return self.query
        with open(self.query_path, encoding="utf-8") as f:
            return f.read()

    def options(self) -> dict[str, str]:
        out = {"url": self.url, **dict(self.properties)}
        if self.partition_on and self.partition_num > 1:
            if self.bounds is None:
                raise ValueError("partitioned reads need the bounds of the column")
            low, high = self.bounds
            return out | {"dbtable": f"({self.text().rstrip().rstrip(';')}) q", "partitionColumn": self.partition_on, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(self.partition_num)}
        return out | {"dbtable": f"({self.text().rstrip().rstrip(';')}) q"}


def read_jdbc(spark: SparkSession, queries: Query | Sequence[Query]) -> DataFrame:
    """One query or the union of several."""
    parts = [spark.read.format("jdbc").options(**q.options()).load() for q in ([queries] if isinstance(queries, Query) else queries)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Kinds of declared columns and how text becomes them: all but plain timestamps give null for what does not convert.
KINDS = ("categorical", "float", "boolean", "timestamp", "integer")


def typed_load(df: DataFrame, columns: Mapping[str, str | tuple[str, str]], subject_id_col: str | None = None, filter_on: Mapping | None = None) -> DataFrame:
    """One select that casts each column by its declared kind: ``categorical``, ``float``, ``boolean``, ``integer``,
    ``timestamp`` or ``("timestamp", format)``; adds ``subject_id``; keeps rows that pass ``filter_on``."""
    from tidemark.operators.filters import include

    if filter_on:
        df = include(df, filter_on)
    out = [F.col(subject_id_col).cast("long").alias("subject_id")] if subject_id_col else []
    for name, kind in columns.items():
        c = F.col(name)
        if isinstance(kind, tuple):
            out.append(F.try_to_timestamp(c, F.lit(kind[1])).alias(name))
        elif kind == "categorical":
            out.append(c.cast("string").alias(name))
        elif kind == "timestamp":
            out.append(c.cast("timestamp").alias(name))
        elif kind in KINDS:
            out.append(c.try_cast({"float": "float", "boolean": "boolean", "integer": "long"}[kind]).alias(name))
        else:
            raise ValueError(f"{name}: unknown kind {kind}")
    return df.select(*out)


def write(df: DataFrame, path: str, overwrite: bool = False, partition_by: Sequence[str] = (), codec: str = "zstd", rows_per_file: int | None = None) -> None:
    """Parquet; raises if the path exists unless ``overwrite``."""
    w = df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", codec)
    w = w.option("maxRecordsPerFile", rows_per_file) if rows_per_file else w
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def merge_groups(spark: SparkSession, paths: Sequence[str], out: str | None, key: str, drop: str | None = None, partitions: int | None = None) -> DataFrame:
    """Many group files as one table, without the columns that match ``drop``, written by the key."""
    df = spark.read.option("mergeSchema", True).parquet(*paths)
    df = df.drop(*pick_columns(df, regex=drop)) if drop else df
    if out is None:
        return df
    write(df.repartition(partitions, key) if partitions else df.repartition(key), out)
    return spark.read.parquet(out)


def with_shards(df: DataFrame, subjects: DataFrame, key: str, per_shard: int, seed: int = 1, split: str = "split") -> DataFrame:
    """Add ``split`` (from ``subjects``) and ``shard``: about ``per_shard`` subjects each, by hash, for partitioned output."""
    sizes = {r[split]: r["n"] for r in subjects.groupBy(split).agg(F.count("*").alias("n")).collect()}  # one row for each split
    n = F.element_at(F.create_map(*[x for s, k in sizes.items() for x in (F.lit(s), F.lit(max(1, -(-k // per_shard))))]), F.col(split))
    return df.join(subjects.select(key, split), key).withColumn("shard", (portable_hash(key, seed) % n).cast("int"))


def sidecar(spark: SparkSession, path: str, value=None):
    """Write (or, without a value, read) a small JSON document beside a dataset, through Spark's file systems."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if value is not None:
        f = fs.create(p, True)
        f.write(bytearray(json.dumps(value, sort_keys=True, indent=1).encode()))
        f.close()
        return value
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if fs.exists(p) else None


def save_tables(path: str, tables: Mapping[str, DataFrame], config: Mapping, overwrite: bool = False) -> None:
    """A dataset: one Parquet folder for each table and ``config.json``."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        write(df, f"{path}/{name}", overwrite)
    sidecar(spark, f"{path}/config.json", {"config": dict(config), "tables": sorted(tables)})


def load_tables(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    found = sidecar(spark, f"{path}/config.json")
    if found is None:
        raise FileNotFoundError(f"{path}/config.json")
    return {name: spark.read.parquet(f"{path}/{name}") for name in found["tables"]}, found["config"]


def task_collection(spark: SparkSession, path: str, prefix: str = "") -> dict[str, DataFrame]:
    """Parquet files below a folder, by their path below it without the ending."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path").collect()
    root = PurePosixPath(re.sub("/+", "/", path.split(":", 1)[-1]))
    out = {}
    for r in sorted(x["path"] for x in files):
        p = PurePosixPath(re.sub("/+", "/", r.split(":", 1)[-1]))
        out[prefix + str(p.relative_to(root).with_suffix(""))] = spark.read.parquet(r)
    return out


def write_missing(df: DataFrame, path: str, key: str, params: Mapping) -> DataFrame:
    """Idempotent cache by values of ``key``: parameters must equal those on record; only values that are not there yet are
    written. Returns the whole cache.

    Each call writes its rows to a folder of its own attempt and then one manifest, which holds the parameters and names the folder.
    Only what a manifest names counts: an attempt that ends before that leaves nothing behind that a later call reads, and the
    next call writes those values again. A value of ``key`` is taken from one attempt, the first by name that has it."""
    spark = df.sparkSession
    mine = json.loads(json.dumps(dict(params)))
    done = manifests(spark, path)
    for m in done:
        if m["params"] != mine:
            raise ValueError(f"{path} was written with other parameters: {m['params']}")
    columns = StructType([f for f in df.schema if f.name != key] + [df.schema[key]])
    old = _attempts(spark, path, done, columns)
    fresh = df.select(columns.names)
    if old is not None:
        have = old.select(F.struct(key).alias("_have")).distinct()
        fresh = fresh.join(have, F.struct(key) == F.col("_have"), "left_anti")
    attempt = uuid.uuid4().hex
    fresh.write.partitionBy(key).parquet(f"{path}/data/{attempt}")
    commit(spark, path, attempt, {"params": mine, "data": attempt, "at": time.time()})
    return _attempts(spark, path, manifests(spark, path), columns)


def manifests(spark: SparkSession, path: str) -> list[dict]:
    """The committed attempts of a cache, oldest first."""
    try:
        rows = spark.read.text(f"{path}/manifests/*/part-*", wholetext=True).collect()  # one for each call that wrote
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted((json.loads(r["value"]) for r in rows if r["value"].strip()), key=lambda m: (m["at"], m["data"]))


def commit(spark: SparkSession, path: str, attempt: str, manifest: Mapping) -> None:
    """Write a manifest; Spark's writer makes its file appear as a whole."""
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifests/{attempt}")


def _attempts(spark: SparkSession, path: str, done: Sequence[Mapping], columns: StructType) -> DataFrame | None:
    if not done:
        return None
    parts = [spark.read.schema(columns).parquet(f"{path}/data/{m['data']}").withColumn("_attempt", F.lit(i)) for i, m in enumerate(done)]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    if len(parts) == 1:
        return rows.drop("_attempt")
    # Two calls that ran at once may both have written a value.
    key = columns.names[-1]
    first = rows.groupBy(F.struct(key).alias("_key")).agg(F.min("_attempt").alias("_first"))
    return rows.join(first, (F.struct(F.col(key)) == F.col("_key")) & (F.col("_attempt") == F.col("_first")), "left_semi").drop("_attempt")


def quarantine(df: DataFrame, key: str, bad, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, malformed): all rows of subjects with a row that is bad go aside, to ``path`` if given."""
    keys = df.filter(bad).select(key).distinct()
    good, malformed = df.join(keys, key, "left_anti"), df.join(keys, key, "left_semi")
    if path:
        write(malformed, path, overwrite=True)
    return good, malformed
