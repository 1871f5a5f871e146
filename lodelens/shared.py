"""Reading input tables, the shared folder in which intermediate tables are kept, and small files that are committed.

Intermediate results that later jobs read more than once are written as Parquet into the folder
that the cluster names in ``spark.checkpoint.dir``; executors may then be lost without losing data.
Only a local session without that setting gets a folder of its own; on a cluster its absence is an error. The folder of
an application is removed when it ends, and earlier by :func:`release`.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan dealt to all cores if it has partitions for less than half of them (one small file, say); a large table is left as it lies.

    For texts that cost much more to work on than to move.
    """
    n = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(n) if 2 * scan.rdd.getNumPartitions() <= n else scan


def shared_folder(spark: SparkSession) -> str:
    """The application's part of the folder all executors share."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not re.fullmatch(r"local(?:\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="lodelens-")
        spark.conf.set("spark.checkpoint.dir", given)
        spark.sparkContext.setCheckpointDir(given)
    folder = f"{given.rstrip('/')}/lodelens-{spark.sparkContext.applicationId}"
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return folder


def release(spark: SparkSession) -> None:
    """Remove all tables kept so far; results that still read them must have been used up."""
    fs, p = _fs(spark, shared_folder(spark))
    for s in fs.listStatus(p):
        fs.delete(s.getPath(), True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_buckets(df: DataFrame, path: str) -> int:
    """Write ``df`` in folders by its column ``bucket``, a large bucket by several tasks and small ones by one; gives the number of rows."""
    seen = Observation()
    df.hint("rebalance", "bucket").observe(seen, F.count(F.lit(1)).alias("n")).write.partitionBy("bucket").parquet(path)
    try:
        return seen.get["n"]
    except Exception:  # a plan known to be empty is not run, and so not observed
        return df.sparkSession.read.schema(df.schema).parquet(path).count()


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def list_files(spark: SparkSession, path: str) -> list[dict]:
    """Name, size and modification time of the files directly under ``path``; empty if missing."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return [
        {"path": s.getPath().toString(), "size": int(s.getLen()), "mtime_ms": int(s.getModificationTime())}
        for s in fs.listStatus(p)
        if s.isFile()
    ]


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly under ``path``."""
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []


def read_json(spark: SparkSession, path: str) -> dict | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        raw = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(raw)


def _write_beside(fs, path, value: dict):
    """A new file with the value beside ``path``, to be renamed into its place."""
    beside = path.suffix(f".{uuid.uuid4().hex[:8]}.new")
    fs.mkdirs(path.getParent())
    out = fs.create(beside, True)
    try:
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    finally:
        out.close()
    return beside


def _rename(spark: SparkSession, source, target, overwrite: bool) -> None:
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE if overwrite else kind.NONE
    context.rename(source, target, options)


def commit_json(spark: SparkSession, path: str, value: dict) -> None:
    """Replace a small JSON file in one step: write beside it, then rename over it."""
    fs, p = _fs(spark, path)
    _rename(spark, _write_beside(fs, p, value), p, True)


class Conflict(RuntimeError):
    """Another writer committed first; nothing of this one counts."""


def newest(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """Number and value of the last version committed in ``folder``; (0, {}) before the first."""
    names = [re.search(r"/v(\d+)\.json$", f["path"]) for f in list_files(spark, folder)]
    n = max((int(m.group(1)) for m in names if m), default=0)
    return n, (read_json(spark, f"{folder}/v{n:09d}.json") or {}) if n else {}


def commit_version(spark: SparkSession, folder: str, version: int, value: dict, keep: int = 4) -> None:
    """Commit version ``version``, the one after that which was read: of two writers the second gets :class:`Conflict`.

    The file appears under its name in one rename that fails if there is one. Versions older than the last ``keep`` are removed.
    """
    fs, p = _fs(spark, f"{folder}/v{version:09d}.json")
    beside = _write_beside(fs, p, value)
    try:
        _rename(spark, beside, p, False)
    except Exception as e:
        fs.delete(beside, False)
        if fs.exists(p):
            raise Conflict(f"version {version} of {folder} was committed by another writer") from e
        raise
    remove(spark, f"{folder}/v{version - keep:09d}.json")
