"""Writers. Each takes a folder that all executors can reach."""

from __future__ import annotations

import functools
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators.evaluation import metrics_pivot
from tallyframe.operators.recommend import with_ids
from tallyframe.operators.tables import added, delete_transactions, update_transactions
from tallyframe.schemas import TX_STORED
from tallyframe.sources import store

REC_STORED = ("id", "message", "type", "priority", "created_at", "category", "amount", "percentage")


def _save(df: DataFrame, path: str, fmt: str, mode: str) -> None:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_transactions(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace the table at ``path``, which ``df`` may itself be read from. The new table is written
    whole to a folder beside it and only then takes its name; until that moment, and whatever fails
    before it, the old table stays as it is."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    mark = uuid.uuid4().hex
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}-{kind}-{mark}")
                for kind in ("new", "old"))
    _save(df, new.toString(), fmt, "errorifexists")
    had = files.exists(target)
    if had and not files.rename(target, old):
        raise OSError(f"cannot move {path} aside; the new table is at {new.toString()}")
    if not files.rename(new, target):
        if had:
            files.rename(old, target)
        raise OSError(f"cannot put the new table at {path}; it is at {new.toString()}")
    if had:
        files.delete(old, True)
    spark.catalog.refreshByPath(path)


def recover(spark: SparkSession, path: str) -> bool:
    """Finish a replacement that was cut off between its two renames: where no table has the name but
    a whole new one lies beside it, that one takes the name. True if it did."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        return False
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}-new-*/_SUCCESS")
    found = files.globStatus(pattern) or []
    whole = sorted(found, key=lambda s: s.getModificationTime())
    return bool(whole) and files.rename(whole[-1].getPath().getParent(), target)


def append_to(path: str, new: DataFrame, now: Column | None = None) -> None:
    """Add rows to a stored table, with ids and a creation time; no old row is read or rewritten. The
    first rows make the table, in the stored columns."""
    spark = new.sparkSession
    if store.is_store(spark, path):
        return store.append_store(path, new, now)
    try:
        schema = spark.read.parquet(path).schema
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        schema = TX_STORED
    rows = added(new, now)
    columns = [F.col(f.name) if f.name in rows.columns else F.lit(None).alias(f.name)
               for f in schema.fields]
    casted = [c.cast(f.dataType).alias(f.name) for c, f in zip(columns, schema.fields)]
    _save(rows.select(*casted), path, "parquet", "append")


def update_in(path: str, patches: DataFrame, now: Column | None = None) -> None:
    """Apply ``update_transactions`` to a stored table: to the touched buckets of a store, or to a
    plain folder as a whole."""
    if store.is_store(patches.sparkSession, path):
        return store.update_store(path, patches, now)
    table = patches.sparkSession.read.parquet(path)
    write_transactions(update_transactions(table, patches, now), path)


def delete_from(path: str, ids: DataFrame) -> None:
    """Apply ``delete_transactions`` to a stored table, as ``update_in`` does."""
    if store.is_store(ids.sparkSession, path):
        return store.delete_store(path, ids)
    write_transactions(delete_transactions(ids.sparkSession.read.parquet(path), ids), path)


def write_series(series: dict[str, DataFrame] | DataFrame, path: str) -> None:
    """Feature tables by frequency, one folder each, as one partitioned table. ``series`` maps a
    frequency code to its table, or is one table with a column ``freq``, as ``series_of_freqs`` makes
    it in one pass."""
    if isinstance(series, DataFrame):
        whole = series
    else:
        parts = [t.withColumn("freq", F.lit(f)) for f, t in series.items()]
        whole = functools.reduce(DataFrame.unionByName, parts)
    whole.write.mode("overwrite").partitionBy("freq").parquet(path)


def _folder_name(column: str) -> Column:
    return F.regexp_replace(F.lower(column), r"\s+", "_")


def write_forecasts(forecasts: DataFrame, path: str) -> None:
    """One folder per forecaster and category, names in lower case with underscores."""
    named = forecasts.withColumns(
        {c: _folder_name(c) for c in ("forecaster", "category")}
    )
    # Rows of one folder meet in few tasks, so a folder does not get a file from every task; a folder
    # that holds most rows is split by size.
    named.hint("rebalance", "forecaster", "category").write.mode("overwrite").partitionBy(
        "forecaster", "category"
    ).parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The long metrics and their pivot next to each other. The metrics are computed once; the pivot
    is made of what was written."""
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    stored = metrics.sparkSession.read.schema(metrics.schema).parquet(f"{path}/metrics")
    metrics_pivot(stored).write.mode("overwrite").parquet(f"{path}/metrics_pivot")


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def stored_recommendations(recs: DataFrame, now: Column | None = None) -> DataFrame:
    return with_ids(recs, now).select(*REC_STORED)


def write_recommendations(recs: DataFrame, path: str, now: Column | None = None) -> None:
    """Recommendations with id and creation time, in the stored columns."""
    stored_recommendations(recs, now).write.mode("overwrite").parquet(path)
