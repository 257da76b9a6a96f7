"""A transaction table that is changed bucket by bucket.

Rows lie in buckets by a hash of their id. A change writes new files for the buckets that it touches,
and takes effect with one small file, the list of the files that make up the table: until that list is
there, readers see the table as it was, and two writers cannot both add the list of one number.

    path/data/<mark>/bucket=<k>/part-*.parquet
    path/lists/<number>.json
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyframe.operators.tables import added, delete_transactions, update_transactions

BUCKETS = 64
CROWDED = 8  # writes that a bucket is spread over before a change rewrites it as one


class StoreConflict(RuntimeError):
    """Another writer has changed the table in the meantime."""


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    folder, files = _files(spark, f"{path}/lists")
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def is_store(spark: SparkSession, path: str) -> bool:
    return bool(_numbers(spark, path.rstrip("/")))


def _load(spark: SparkSession, path: str) -> dict:
    numbers = _numbers(spark, path)
    if not numbers:
        raise FileNotFoundError(f"no table at {path}")
    text = spark.read.text(f"{path}/lists/{numbers[-1]}.json", wholetext=True).first()[0]
    return json.loads(text) | {"number": numbers[-1]}


def _publish(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """The one step with which a change takes effect: a list, written aside, gets its number. The
    rename fails where that number is taken."""
    aside, files = _files(spark, f"{path}/lists/.{uuid.uuid4().hex}")
    out = files.create(aside, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    target = jvm.Path(f"{path}/lists/{number}.json")
    modes = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    modes[0] = getattr(jvm.Options.Rename, "NONE")
    context = jvm.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(files.makeQualified(aside), files.makeQualified(target), modes)
    except Exception as error:
        files.delete(aside, False)
        if files.exists(target):
            raise StoreConflict(f"{path} has changed; version {number} is taken") from error
        raise


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(buckets)).cast("int")


def _written(df: DataFrame, path: str, buckets: int) -> dict[str, list[str]]:
    """Write rows by bucket under a new mark; the buckets that got files. Rows of a bucket meet in
    few tasks, and a large bucket is split by size."""
    mark = uuid.uuid4().hex
    folder = f"{path}/data/{mark}"
    df.withColumn("bucket", _bucket(buckets)).hint("rebalance", "bucket").write.partitionBy(
        "bucket").parquet(folder)
    target, files = _files(df.sparkSession, folder)
    names = [s.getPath().getName() for s in files.listStatus(target)]
    return {n.removeprefix("bucket="): [mark] for n in names if n.startswith("bucket=")}


def _rows(spark: SparkSession, path: str, content: dict, only: list[str] | None = None) -> DataFrame:
    schema = StructType.fromJson(content["schema"])
    held = content["held"]
    folders = [f"{path}/data/{mark}/bucket={k}" for k in (held if only is None else only)
               for mark in held.get(k, [])]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def create_store(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Make ``df`` the content of the table at ``path``, which may be there already and may be what
    ``df`` is read from. Rows need an ``id``; rows without one share a bucket."""
    spark, path = df.sparkSession, path.rstrip("/")
    number = max(_numbers(spark, path), default=-1) + 1
    held = _written(df, path, buckets)
    _publish(spark, path, number, {"buckets": buckets, "schema": df.schema.jsonValue(),
                                   "held": held})


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The table as of now; later changes do not show in the returned rows."""
    path = path.rstrip("/")
    return _rows(spark, path, _load(spark, path))


def append_store(path: str, new: DataFrame, now: Column | None = None) -> None:
    """Add rows, with ids and a creation time. No old file is read or rewritten."""
    spark, path = new.sparkSession, path.rstrip("/")
    content = _load(spark, path)
    rows = added(new, now)
    fields = StructType.fromJson(content["schema"]).fields
    rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(
        f.dataType).alias(f.name) for f in fields])
    held = dict(content["held"])
    for bucket, marks in _written(rows, path, content["buckets"]).items():
        held[bucket] = held.get(bucket, []) + marks
    _publish(spark, path, content["number"] + 1, {
        "buckets": content["buckets"], "schema": content["schema"], "held": held})


def _change(path: str, by: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
    spark, path = by.sparkSession, path.rstrip("/")
    content = _load(spark, path)
    buckets, held = content["buckets"], dict(content["held"])
    # At most one row for each bucket reaches the driver.
    touched = {str(r[0]) for r in by.select(_bucket(buckets)).distinct().collect()}
    touched = sorted(touched & set(held))
    if not touched:
        return
    touched += [k for k in held if len(held[k]) > CROWDED and k not in touched]
    old = _rows(spark, path, content, touched)
    rows = change(old)
    rows = rows.select(*[c for c in rows.columns if c in old.columns])
    fresh = _written(rows, path, buckets)
    for bucket in touched:
        held.pop(bucket)
    held.update(fresh)
    _publish(spark, path, content["number"] + 1, {
        "buckets": buckets, "schema": content["schema"], "held": held})


def update_store(path: str, patches: DataFrame, now: Column | None = None) -> None:
    """Apply ``update_transactions`` to the buckets that hold patched ids; other files stay."""
    _change(path, patches, lambda old: update_transactions(old, patches, now))


def delete_store(path: str, ids: DataFrame) -> None:
    """Drop the rows with these ids; only their buckets are rewritten."""
    _change(path, ids, lambda old: delete_transactions(old, ids))


def clean_store(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete files that none of the last ``keep`` lists names, and older lists; the marks deleted.
    Not to be run while another job changes the table or reads an older state."""
    path = path.rstrip("/")
    numbers = _numbers(spark, path)
    used = set()
    for number in numbers[-max(keep, 1):]:
        text = spark.read.text(f"{path}/lists/{number}.json", wholetext=True).first()[0]
        used.update(m for marks in json.loads(text)["held"].values() for m in marks)
    folder, files = _files(spark, f"{path}/data")
    gone = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName() not in used]
    for old in gone:
        files.delete(old, True)
    for number in numbers[:-max(keep, 1)]:
        files.delete(_files(spark, f"{path}/lists/{number}.json")[0], False)
    return [p.getName() for p in gone]
