"""Tables in hash buckets, of which a merge rewrites only those that it touches.

    <root>/data/generation=<id>/bucket=<k>/part-*.parquet
    <root>/versions/<n>.json        which generation holds each bucket, and schema and keys

A row's bucket is a hash of its key. A merge reads the touched buckets, writes them as a new
generation and then adds a version file, which is written beside and renamed as the last step. A
reader takes the last version; a writer that dies leaves the table as it was, and its files behind.
Two writers cannot both add the same version. No file is ever changed, so readers of an older
version go on undisturbed until :func:`expire` removes what no kept version names.
"""

from __future__ import annotations

import json
import uuid
from typing import Iterable, NamedTuple, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from hearsay.operators.merge import insert_ignore, upsert

BUCKET = "bucket"


class Version(NamedTuple):
    """What a version file says; ``where`` is the generation of every bucket that has rows."""

    number: int
    buckets: int
    keys: tuple[str, ...]
    schema: StructType
    where: dict[int, str]


class Conflict(RuntimeError):
    """Another writer has added the version meanwhile; merge again on top of it."""


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, folder: str) -> list[str]:
    path, fs = _path(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions there are, the last one last."""
    names = _listed(spark, f"{root}/versions")
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def version(spark: SparkSession, root: str, number: int | None = None) -> Version | None:
    """A version of the table, the last one by default; None where there is none."""
    if number is None:
        known = versions(spark, root)
        if not known:
            return None
        number = known[-1]
    path, fs = _path(spark, f"{root}/versions/{number}.json")
    stream = fs.open(path)
    try:
        said = json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()
    return Version(number, said["buckets"], tuple(said["keys"]),
                   StructType.fromJson(said["schema"]),
                   {int(k): g for k, g in said["where"].items()})


def _add_version(spark: SparkSession, root: str, new: Version) -> None:
    said = {"buckets": new.buckets, "keys": new.keys, "schema": new.schema.jsonValue(),
            "where": new.where}
    made, fs = _path(spark, f"{root}/versions/_{uuid.uuid4().hex}")
    stream = fs.create(made)
    stream.write(json.dumps(said).encode())
    stream.close()
    final, _ = _path(spark, f"{root}/versions/{new.number}.json")
    if fs.exists(final) or not fs.rename(made, final):
        fs.delete(made, False)
        raise Conflict(f"version {new.number} of {root} is there already")


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, root: str, keys: Sequence[str], buckets: int) -> dict[int, str]:
    """Rows as a new generation; the buckets that have any. Tasks are one bucket each."""
    generation = uuid.uuid4().hex
    folder = f"{root}/data/generation={generation}"
    rows.withColumn(BUCKET, bucket_of(keys, buckets)).repartition(buckets, BUCKET).write.partitionBy(
        BUCKET).parquet(folder)
    return {int(n.split("=")[1]): generation for n in _listed(rows.sparkSession, folder)
            if n.startswith(f"{BUCKET}=")}


def create(rows: DataFrame, root: str, keys: Sequence[str], buckets: int = 256) -> Version:
    """A new table with one row per key. Take as many buckets as make one a task's work: a merge
    never reads or writes less than a bucket."""
    spark = rows.sparkSession
    if versions(spark, root):
        raise Conflict(f"{root} is a table already")
    new = Version(0, buckets, tuple(keys), rows.schema, _write(rows, root, keys, buckets))
    _add_version(spark, root, new)
    return new


def read(spark: SparkSession, root: str, number: int | None = None,
         only: Iterable[int] | None = None) -> DataFrame:
    """The table at a version, or some of its buckets; only their files are listed."""
    at = version(spark, root, number)
    return _read(spark, root, at, at.where if only is None else only)


def _read(spark: SparkSession, root: str, at: Version, only: Iterable[int]) -> DataFrame:
    paths = [f"{root}/data/generation={at.where[k]}/{BUCKET}={k}"
             for k in sorted(set(only)) if k in at.where]
    if not paths:
        return spark.createDataFrame([], at.schema)
    return spark.read.schema(at.schema).parquet(*paths)


def _touching(rows: DataFrame, at: Version) -> tuple[DataFrame, list[int]]:
    """Rows with keys of the table's types, and the buckets they fall into."""
    typed = rows.withColumns({k: F.col(k).cast(at.schema[k].dataType) for k in at.keys})
    found = typed.select(bucket_of(at.keys, at.buckets).alias(BUCKET)).distinct().collect()
    return typed, [r[0] for r in found]  # at most ``buckets``


def _switch(spark: SparkSession, root: str, at: Version, rows: DataFrame) -> Version:
    made = _write(rows, root, at.keys, at.buckets)
    new = at._replace(number=at.number + 1, where=at.where | made)
    _add_version(spark, root, new)
    return new


def merge(spark: SparkSession, root: str, updates: DataFrame, seq: str,
          null_overwrites: bool = True, kept: Sequence[str] = ("fetched_at",)) -> Version:
    """Upsert into the touched buckets; see :func:`hearsay.operators.merge.upsert`. Merging the
    same updates again gives the same rows."""
    at = version(spark, root)
    typed, touched = _touching(updates, at)
    if not touched:
        return at
    base = _read(spark, root, at, touched)
    return _switch(spark, root, at, upsert(base, typed, at.keys, seq, null_overwrites, kept))


def append_new(spark: SparkSession, root: str, rows: DataFrame, seq: Sequence[str]) -> Version:
    """Rows whose key is not there yet, the first of a key; only their buckets are rewritten."""
    at = version(spark, root)
    typed, touched = _touching(rows, at)
    if not touched:
        return at
    base = _read(spark, root, at, touched)
    return _switch(spark, root, at, insert_ignore(base, typed, at.keys, seq))


def lookup(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """Rows with the keys of ``wanted``, from their buckets alone."""
    at = version(spark, root)
    typed, touched = _touching(wanted, at)
    return _read(spark, root, at, touched).join(
        typed.select(*at.keys).distinct(), list(at.keys), "left_semi")


def expire(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Remove all but the last ``keep`` versions and the buckets that none of them names; the
    number of buckets removed. No merge may be under way."""
    known = versions(spark, root)
    named = {(g, k) for n in known[-keep:] for k, g in version(spark, root, n).where.items()}
    for n in known[:-keep]:
        path, fs = _path(spark, f"{root}/versions/{n}.json")
        fs.delete(path, False)
    removed = 0
    for folder in _listed(spark, f"{root}/data"):
        generation = folder.partition("=")[2]
        for name in _listed(spark, f"{root}/data/{folder}"):
            k = name.partition("=")[2]
            if k.isdigit() and (generation, int(k)) not in named:
                path, fs = _path(spark, f"{root}/data/{folder}/{name}")
                fs.delete(path, True)
                removed += 1
    return removed
