"""Cohort jobs: inclusion, preprocessing, code tables, encodings, index dates and tasks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.encodings import dense_index
from tidemark.functions.quantiles import wide
from tidemark.functions.scalars import before_dot, blank_to_null, cut_right, date_plus_seconds
from tidemark.operators import filters as P
from tidemark.operators import windows as Wn
from tidemark.operators.aggs import edge_row, value_counts


def select_cohort(episodes: DataFrame, deaths: DataFrame, first: str, last: str, key: str = "subject", start: str = "start", end: str = "end", age: str = "age", drop: Sequence[Column] = (), least_rows: int = 2) -> DataFrame:
    """Episodes of the subjects in the cohort, in the order of the rules: study window, exclusions, enough episodes,
    no activity after death, a known age on some row. ``deaths``: (key, died)."""
    df = P.study_window(episodes, start, end, first, last)
    for cond in drop:
        df = P.exclude(df, cond)
    df = P.min_rows(df, key, least_rows)
    df = P.drop_after_event(df, key, end, deaths, "died")
    return P.drop_all_null(df, key, age)


def cohort_outputs(cohort: DataFrame, key: str, records: Mapping[str, str]) -> dict[str, DataFrame]:
    """The subjects and the record ids of each source (name -> id column, null for rows of other sources)."""
    return {"subjects": cohort.select(key).distinct()} | {name: cohort.filter(F.col(c).isNotNull()).select(c).distinct() for name, c in records.items()}


def restrict(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def preprocess(df: DataFrame, key: str, start: str, start_seconds: str, end: str, end_seconds: str, fill: Sequence[str], codes: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Times from dates and seconds, filled static columns, gap to the stay before, number of stays before, stay
    length and the list of codes."""
    df = df.withColumn("start_ts", date_plus_seconds(start, start_seconds)).withColumn("end_ts", date_plus_seconds(end, end_seconds))
    df = Wn.fill(df, fill, key, order)
    df = Wn.gap_days(df, key, start, end, order, "gap_days")
    df = Wn.running_count(df, key, start, order, "n_before")
    listed = F.array_distinct(F.filter(F.array(*codes), lambda x: x.isNotNull() & (x != "")))
    return df.withColumn("stay_days", F.datediff(end, start) + 1).withColumn("codes", listed)


def melt_codes(df: DataFrame, ids: Sequence[str], cols: Sequence[str], short: bool = True) -> DataFrame:
    """Wide code columns to distinct (ids, code) rows, without blanks; ``short`` drops what follows a dot."""
    long = df.unpivot(list(ids), list(cols), "_slot", "code").select(*ids, blank_to_null("code").alias("code")).dropna(subset=["code"])
    return (long.withColumn("code", before_dot("code")) if short else long).distinct()


def melt_blocks(df: DataFrame, ids: Sequence[str], cols: Sequence[str], breaks: Sequence[float], chapters: Sequence[str]) -> DataFrame:
    """Numeric block columns to distinct (ids, block, chapter) rows; the chapter is the interval (a, b] of the block."""
    long = df.unpivot(list(ids), list(cols), "_slot", "block").select(*ids, F.col("block").try_cast("int").alias("block")).dropna(subset=["block"])
    return long.withColumn("chapter", cut_right("block", breaks, chapters)).distinct()


def static_table(df: DataFrame, key: str, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """The static columns of each subject's first row."""
    return edge_row(df.select(*dict.fromkeys([key, *order, *cols])), key, order).select(key, *cols)


def data_map(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], rare: int) -> tuple[dict[str, list[float]], DataFrame]:
    """Edges (distinct 5..95 percentiles in steps of 5) of numeric columns, and codes (variable, value, code)
    of categorical ones after folding rare values; codes follow the order of the values."""
    qs = [i / 100 for i in range(5, 100, 5)]
    found = wide(df, {f"{i}:{q}": (c, q) for i, c in enumerate(numeric) for q in qs}).first() if numeric else {}
    row = {c: sorted({v for q in qs if (v := found[f"{i}:{q}"]) is not None}) for i, c in enumerate(numeric)}
    codes = None
    for c in categorical:
        folded = P.fold_rare(df.select(F.col(c).cast("string").alias(c)), [c], rare)
        part = dense_index(folded, c).select(F.lit(c).alias("variable"), F.col(c).alias("value"), F.col("idx").alias("code"))
        codes = part if codes is None else codes.unionByName(part)
    return {c: list(row[c]) for c in numeric}, codes


def variable_map(sizes: DataFrame, order: str = "variable", size: str = "size") -> DataFrame:
    """Each variable's range of token ids."""
    return Wn.offsets(sizes, size, [order]).select(order, size, "start", "end")


def encode_visits(df: DataFrame, key: str, order: Sequence[str], edges: Mapping[str, Sequence[float]], codes: DataFrame, offsets: Mapping[str, int]) -> DataFrame:
    """(key, visits): per subject, in order, the sorted token ids of each episode. Numeric columns fall into bins of
    their edges; categorical values are looked up in ``codes``, unknown ones in the code of ``other`` if it has one."""
    tokens = [F.lit(offsets[c]) + cut_right(c, e) for c, e in edges.items()]
    variables = [r["variable"] for r in codes.select("variable").distinct().collect()]
    # One lookup for all variables: the different values of each in the rows meet their codes, and the result is a map from
    # value to token for each variable. A vocabulary of this encoding is one of categories, a row for each.
    names = F.array(*[F.struct(F.lit(c).alias("variable"), F.lit(offsets[c]).alias("offset")) for c in variables])
    table = codes.filter(F.col("value").isNotNull()).join(codes.sparkSession.range(1).select(F.inline(names)), "variable")
    maps = table.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\u0000", "variable", "value").alias("k"), (F.col("offset") + F.col("code")).cast("int").alias("t")))).alias("_codes"))
    rows = df.join(F.broadcast(maps))  # one row
    code = lambda c, v: F.try_element_at("_codes", F.concat_ws("\u0000", F.lit(c), v))
    tokens += [F.when(F.col(c).isNotNull(), F.coalesce(code(c, F.col(c).cast("string")), code(c, F.lit("other")))) for c in variables]
    visit = F.array_sort(F.array_compact(F.array(*[x.cast("int") for x in tokens])))
    return rows.withColumn("_v", visit).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "_v"))), lambda x: x["_v"]).alias("visits"))


def split_by_lists(df: DataFrame, lists: Mapping[str, DataFrame], key: str, list_key: str) -> dict[str, DataFrame]:
    return {name: df.join(ids.select(F.col(list_key).alias(key)), key, "left_semi") for name, ids in lists.items()}


def pick_index(df: DataFrame, key: str, order: Sequence[str], seed: int, discharge: Column, deaths: DataFrame, end: str) -> DataFrame:
    """One random discharge row per subject, never of a stay that ends at or after the subject's death."""
    rows = df.filter(discharge).join(deaths.select(key, "died"), key, "left").filter(F.col("died").isNull() | (F.col(end) < F.col("died"))).drop("died")
    return Wn.pick_random(rows, key, order, seed)


def follow_up(index: DataFrame, deaths: DataFrame, key: str, index_ts: str, study_end: str, days: Sequence[int] = (180, 365, 730)) -> DataFrame:
    """Days from the index to the study's end or death, and for each horizon whether the subject was followed for longer or died."""
    last = F.least(F.lit(study_end).cast("date"), F.coalesce(F.col("died"), F.lit(study_end).cast("date")))
    out = index.join(deaths.select(key, "died"), key, "left").withColumn("followup_days", F.datediff(last, F.col(index_ts)))
    return out.withColumns({f"include_{d}": (F.col("followup_days") > d) | F.col("died").isNotNull() for d in days}).drop("died")


def task_table(index: DataFrame, key: str, index_ts: str, label: Mapping[str, Column], delay_ms: int = 100) -> DataFrame:
    """subject_id, start_time (null: all history), end_time just after the index, labels."""
    end = F.timestamp_micros(F.unix_micros(F.col(index_ts).cast("timestamp")) + delay_ms * 1000)
    return index.select(F.col(key).alias("subject_id"), F.lit(None).cast("timestamp").alias("start_time"), end.alias("end_time"), *[c.alias(n) for n, c in label.items()])


def last_but_one_task(events: DataFrame, key: str, ts: str, admission: Column) -> DataFrame:
    """Task ending a minute after the last event before the last admission; the label is whether that event is itself an admission."""
    rows = Wn.before_last(events.withColumn("_adm", admission), key, ts, F.col("_adm"))
    end = F.timestamp_micros(F.unix_micros(F.col(ts).cast("timestamp")) + 60_000_000)
    return rows.select(F.col(key).alias("subject_id"), F.lit(None).cast("timestamp").alias("start_time"), end.alias("end_time"), F.col("_adm").alias("label"))


def outcome_report(labels: DataFrame, outcome: str, deaths: DataFrame, key: str) -> DataFrame:
    """(group, n, mean, median, max) of an outcome over all subjects and those who died."""
    marked = labels.join(deaths.select(key).distinct().withColumn("_d", F.lit(True)), key, "left")
    rows = marked.select(outcome, F.explode(F.when(F.col("_d"), F.array(F.lit("all"), F.lit("died"))).otherwise(F.array(F.lit("all")))).alias("group"))
    return rows.groupBy("group").agg(F.count("*").alias("n"), F.avg(outcome).alias("mean"), F.percentile(outcome, F.lit(0.5)).alias("median"), F.max(outcome).alias("max"))


def report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, count): the value counts of several columns."""
    out = None
    for c in cols:
        part = value_counts(df, c).select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), "count")
        out = part if out is None else out.unionByName(part)
    return out


