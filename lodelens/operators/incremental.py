"""Processing only new or changed records, exactly once across failures.

Two operators share the rule "a manifest says what has been done, an anti-join says what is left":

* :func:`files_to_index` works on tables: the manifest is what *succeeded* runs wrote, so a run that
  failed half-way leaves no trace in it and its files come up again.
* :class:`IncrementalRun` works on folders of input files: it lists, anti-joins the listing with its
  manifest, writes the batch under its own identifier and commits the manifest last. :func:`index_pending` does
  the same for a scan that is a table.
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Callable
from urllib.parse import quote

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodelens import shared


def plain_hash(c: Column) -> Column:
    """Hash without letter case, blanks and a ``sha256:`` prefix; null if nothing is left."""
    bare = F.regexp_replace(F.lower(F.trim(c)), "^sha256:", "")
    return F.when(bare != "", bare)


def latest_scan(scan: DataFrame) -> DataFrame:
    """Per project and path the row last scanned. Ties go to the greatest (hash, mtime, size).

    An aggregate on a struct, so repeated rows are combined before the shuffle.
    """
    newest = F.max(
        F.struct("scanned_at", plain_hash(F.col("file_hash")).alias("hash"), "mtime_ns", "size")
    ).alias("now")
    return (
        scan.where(F.col("rel_path").isNotNull())
        .groupBy("project_id", "rel_path")
        .agg(newest)
        .select("project_id", "rel_path", "now.hash", "now.mtime_ns", "now.size")
    )


def succeeded_runs(runs: DataFrame) -> DataFrame:
    """Runs whose status of the latest ``logged_at`` is succeeded, in any letter case."""
    last = F.max(F.struct("logged_at", F.lower(F.trim("status")).alias("status"), "run_seq")).alias("last")
    return (
        runs.groupBy("project_id", "run_id")
        .agg(last, F.max("run_seq").alias("run_seq"))
        .where(F.col("last.status") == "succeeded")
        .select("project_id", "run_id", "run_seq")
    )


def indexed_files(files: DataFrame, runs: DataFrame) -> DataFrame:
    """The manifest: per project and path what the succeeded run of highest ``run_seq`` wrote.

    The same run may hold a path in several rows; the greatest (hash, mtime, size) then counts.
    """
    newest = F.max(
        F.struct("run_seq", plain_hash(F.col("file_hash")).alias("hash"), "mtime_ns", "size")
    ).alias("was")
    return (
        files.select("project_id", "run_id", "rel_path", "file_hash", "mtime_ns", "size")
        .join(succeeded_runs(runs), ["project_id", "run_id"])
        .groupBy("project_id", "rel_path")
        .agg(newest)
        .select("project_id", "rel_path", "was.hash", "was.mtime_ns", "was.size")
    )


def same_content(a: str, b: str) -> Column:
    """Hashes decide; where one is missing, equal and known size and mtime. Never null."""
    ha, hb = F.col(f"{a}.hash"), F.col(f"{b}.hash")
    stat = (F.col(f"{a}.size") == F.col(f"{b}.size")) & (F.col(f"{a}.mtime_ns") == F.col(f"{b}.mtime_ns"))
    return F.when(ha.isNotNull() & hb.isNotNull(), ha == hb).otherwise(F.coalesce(stat, F.lit(False)))


def files_to_index(scan: DataFrame, files: DataFrame, runs: DataFrame) -> DataFrame:
    """Paths of the present scan that the index lacks or holds with other content, each once.

    Anti-join of the scan with the manifest. Null ``project_id`` values match each other; rows without
    ``rel_path`` name no file and are left out. Empty tables: an empty scan gives nothing, an empty
    index gives the whole scan. Columns beyond those used are never read.
    """
    now, was = latest_scan(scan).alias("now"), indexed_files(files, runs).alias("was")
    known = (
        F.col("now.project_id").eqNullSafe(F.col("was.project_id"))
        & (F.col("now.rel_path") == F.col("was.rel_path"))
        & same_content("now", "was")
    )
    return now.join(was, known, "left_anti").select("project_id", "rel_path")


def change_states(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer comparison of two manifests (hash, mtime_ns, size): added, changed, deleted, unchanged."""
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    both = old.withColumn("there", F.lit(True)).alias("o").join(
        new.withColumn("there", F.lit(True)).alias("n"), on, "full_outer"
    )
    state = (
        F.when(F.col("o.there").isNull(), "added")
        .when(F.col("n.there").isNull(), "deleted")
        .when(same_content("n", "o"), "unchanged")
        .otherwise("changed")
    )
    return both.select(*[F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys], state.alias("state"))


class Ledger:
    """What has been processed: manifest parts, one a batch, and a committed version that names those which count.

    A part has the key columns, ``entry`` columns and ``state`` (present or deleted). Of the parts that hold a key the one committed last
    counts, so a record that changes to what it once was is a change like any other.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str]):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys
        self.schema = f"{schema}, state string"

    def batches(self) -> list[str]:
        """Committed batches, oldest first."""
        return shared.newest(self.spark, f"{self.folder}/commits")[1].get("batches", [])

    def entries(self, with_deleted: bool = False) -> DataFrame:
        """The newest committed row per key, with the column ``batch``; of deleted keys only if asked for."""
        batches, rows = self.batches(), None
        schema = f"{self.schema}, batch string, seq int"
        for i, b in enumerate(batches):
            part = self.spark.read.schema(self.schema).parquet(f"{self.folder}/manifest/{b}").withColumns({"batch": F.lit(b), "seq": F.lit(i)})
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            rows = self.spark.createDataFrame([], schema)
        others = [c for c in rows.columns if c not in (*self.keys, "seq")]
        last = rows.groupBy(*self.keys).agg(F.max(F.struct("seq", *others)).alias("r")).select(*self.keys, *[f"r.{c}" for c in others])
        return last if with_deleted else last.where("state = 'present'")

    def record(self, batch: str, part: DataFrame) -> None:
        """Write the manifest part of a batch, over what a failed attempt may have left."""
        part.select(*[c.split()[0] for c in self.schema.split(", ")]).write.mode("overwrite").parquet(f"{self.folder}/manifest/{batch}")

    def commit(self, version: int, batch: str) -> None:
        """Make a batch count; refused (:class:`lodelens.shared.Conflict`) if another run committed since ``version`` was read."""
        done = self.batches() if version else []
        shared.commit_version(self.spark, f"{self.folder}/commits", version + 1, {"batches": [*done, batch]})

    def version(self) -> int:
        return shared.newest(self.spark, f"{self.folder}/commits")[0]


def batch_id(rows: DataFrame, version: int) -> str | None:
    """Identifier of a set of rows to process, whatever their order; None if there are none. A repeated attempt gets the same one."""
    keys = [F.xxhash64(F.lit(seed), *rows.columns) for seed in (0, 1)]
    r = rows.agg(F.count("*").alias("n"), *[F.sum(k.cast("decimal(38,0)")).alias(f"s{i}") for i, k in enumerate(keys)]).first()
    return hashlib.sha256(f"{version}|{r.n}|{r.s0}|{r.s1}".encode()).hexdigest()[:16] if r.n else None


def index_pending(scan: DataFrame, files: DataFrame, runs: DataFrame, state: str | None = None) -> DataFrame:
    """:func:`files_to_index` as a run that is committed: (project_id, rel_path) of the files that the next indexing run must take.

    The listing (the present scan with its size, time and hash) is anti-joined with the manifest: what earlier indexing runs wrote, and
    over that what runs committed in the ledger ``state`` took. The result is written under its batch identifier, then the manifest part
    is written and committed; what is returned is read from the committed batch. A run that fails before the commit leaves nothing that
    counts, and the next one writes to the same place. Without ``state`` the ledger is a new one.
    """
    spark = scan.sparkSession
    folder = state or shared.fresh_path(spark, "ledger")
    ledger = Ledger(spark, folder, "project_id string, rel_path string, hash string, mtime_ns long, size long", ["project_id", "rel_path"])
    version = ledger.version()
    now, was = latest_scan(scan), indexed_files(files, runs)
    if version:
        taken = ledger.entries().select(*was.columns)
        keys = [F.col(f"w.{k}").eqNullSafe(F.col(f"t.{k}")) for k in ledger.keys]
        was = was.alias("w").join(taken.select(*ledger.keys).alias("t"), keys, "left_anti").unionByName(taken)
    n, w = now.alias("now"), was.alias("was")
    known = F.col("now.project_id").eqNullSafe(F.col("was.project_id")) & (F.col("now.rel_path") == F.col("was.rel_path")) & same_content("now", "was")
    todo = shared.kept(n.join(w, known, "left_anti").select(*now.columns), "pending")
    batch = batch_id(todo, version)
    if batch is None:
        return todo.select("project_id", "rel_path")
    out = f"{folder}/out/batch={batch}"
    todo.select("project_id", "rel_path").write.mode("overwrite").parquet(out)
    ledger.record(batch, todo.withColumn("state", F.lit("present")))
    ledger.commit(version, batch)
    return spark.read.schema("project_id string, rel_path string").parquet(out)


# -- folders of input files -----------------------------------------------------------------------
_LISTED = "path string, folder boolean, size long, mtime_ns long"
#: Files of one batch, so that the list of paths a reader gets stays bounded; a run makes as many batches as it takes.
MAX_FILES = 50_000


def plain_uri(c: Column) -> Column:
    """One spelling of a file's address: ``file:/a`` for ``file:///a`` and ``/a``."""
    return F.regexp_replace(F.regexp_replace(c, "^/", "file:/"), "^file:/+", "file:/")


def _storage(address: str):
    """The file system of an address, and the path in it."""
    scheme, _, rest = address.partition(":")
    return (pafs.LocalFileSystem(), rest) if scheme == "file" else pafs.FileSystem.from_uri(quote(address, safe=":/@"))


def _list_folders(batches):
    for pdf in batches:
        for folder in pdf["path"]:
            where, base = _storage(folder)
            head = folder.removesuffix(base)
            rows = [
                (head + i.path, i.type == pafs.FileType.Directory, i.size or 0, i.mtime_ns or 0)
                for i in where.get_file_info(pafs.FileSelector(base)) if not i.base_name.startswith(("_", "."))
            ]
            for at in range(0, len(rows), 10_000):
                yield pd.DataFrame(rows[at : at + 10_000], columns=[c.split()[0] for c in _LISTED.split(", ")])


def list_tree(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, size, mtime_ns) of all files below ``folder`` whose name fits; folders are listed in parallel, one level a round."""
    level = spark.createDataFrame([(folder.rstrip("/"),)], "path string").select(plain_uri(F.col("path")).alias("path"))
    files, n, depth = None, 1, 0
    name = F.substring_index("path", "/", -1)
    while n:
        tasks = min(n, 4 * spark.sparkContext.defaultParallelism)
        seen = shared.kept(level.repartition(tasks).mapInPandas(_list_folders, _LISTED), f"listing{depth}")
        here = seen.where("NOT folder").where(name.rlike(fnmatch.translate(glob).replace("(?s:", "(?s)(?:").replace("\\Z", "$"))).select("path", "size", "mtime_ns")
        files = here if files is None else files.unionByName(here)
        level, depth = seen.where("folder").select("path"), depth + 1
        n = level.count()
    return files


def _digests(batches):
    for pdf in batches:
        sums = []
        for path in pdf["path"]:
            where, base = _storage(path)
            h = hashlib.sha256()
            with where.open_input_stream(base) as f:
                while block := f.read(1 << 23):
                    h.update(block)
            sums.append(h.hexdigest())
        yield pdf.assign(checksum=sums)


class IncrementalRun:
    """Apply a transformation to input files that are new or changed since the last successful run.

    A run (1) lists the inputs with size and time, (2) compares the listing with the newest manifest entry per path, and takes the checksum only
    of files whose size or time differ, read in blocks by the executors, (3) writes the result to ``out``/batch=<id>, over whatever an
    earlier failed attempt left there, (4) writes the manifest part, (5) commits by creating the next version file. A failure before
    (5) changes nothing that readers see; the batch identifier is a hash of the files to do, so the repeated run writes to the same
    place. Of two runs at once the second to commit is refused. Input files that vanished are recorded as deleted.
    With ``checksum="mtime"`` size and time alone decide and no file is read but for its records.
    """

    def __init__(self, spark: SparkSession, state: str, out: str, checksum: str = "content", max_files: int = MAX_FILES):
        self.spark, self.out, self.checksum, self.max_files = spark, out.rstrip("/"), checksum, max_files
        self.ledger = Ledger(spark, state, "path string, size long, mtime_ns long, checksum string, source_batch string", ["path"])

    def manifest(self) -> DataFrame:
        """The newest entry of each path that is there: size, mtime_ns, checksum, and the batch its records stand in."""
        return self.ledger.entries()

    def compared(self, folder: str, glob: str = "*") -> DataFrame:
        """(path, size, mtime_ns, checksum, was, state) of all paths that are not as the manifest has them: pending, touched, deleted.

        Touched files have another time but their old content; they are recorded, not processed.
        """
        now = list_tree(self.spark, folder, glob).alias("n")
        was = self.ledger.entries().alias("w")
        j = now.join(was, F.col("n.path") == F.col("w.path"), "full_outer").where(
            F.col("n.path").isNull() | F.col("w.path").isNull() | (F.col("n.size") != F.col("w.size")) | (F.col("n.mtime_ns") != F.col("w.mtime_ns"))
        )
        j = shared.kept(j.select(
            F.coalesce("n.path", "w.path").alias("path"), "n.size", "n.mtime_ns", F.col("w.checksum").alias("was"), F.col("w.source_batch").alias("source_batch"),
            F.col("n.path").isNull().alias("gone"),
        ), "changed")
        here = j.where("NOT gone")
        if self.checksum == "content":
            tasks = 4 * self.spark.sparkContext.defaultParallelism
            here = here.repartition(tasks, "path").mapInPandas(_digests, "path string, size long, mtime_ns long, was string, source_batch string, gone boolean, checksum string")
        else:
            here = here.withColumn("checksum", F.concat_ws(":", "size", "mtime_ns"))
        state = F.when(F.col("gone"), "deleted").when(F.col("checksum").eqNullSafe(F.col("was")), "touched").otherwise("pending")
        every = here.unionByName(j.where("gone").withColumn("checksum", F.lit(None).cast("string")))
        return every.withColumn("state", state).drop("gone")

    def pending(self, folder: str, glob: str = "*") -> DataFrame:
        return self.compared(folder, glob).where("state = 'pending'").select("path", "size", "mtime_ns", "checksum")

    def run(self, folder: str, transform: Callable[[DataFrame], DataFrame], reader=None, glob: str = "*") -> list[str]:
        """Process what is pending; gives the identifiers of the batches committed, none if nothing was to do.

        ``reader(spark, paths)`` loads the files of one batch (Parquet unless given); rows of the default reader get the column
        ``source_path``. A transformation that keeps it lets :meth:`result` leave out the rows of files that have changed since.
        """
        found = shared.kept(self.compared(folder, glob), "compared")
        states = {r.state: r.n for r in found.groupBy("state").agg(F.count("*").alias("n")).collect()}
        if not states:
            return []
        parts = max(1, -(-states.get("pending", 0) // self.max_files))
        load = reader or (lambda s, p: s.read.parquet(*p))
        slot = F.when(F.col("state") == "pending", F.pmod(F.xxhash64("path"), F.lit(parts))).otherwise(0)
        done = []
        for i in range(parts):
            version = self.ledger.version()
            part = found.where(slot == i)
            batch = batch_id(part, version)
            if batch is None:
                continue
            paths = [r.path for r in part.where("state = 'pending'").select("path").orderBy("path").toLocalIterator()]
            if paths:
                rows = load(self.spark, [p.replace("file:/", "file:///", 1) for p in paths])
                if reader is None:
                    rows = rows.withColumn("source_path", plain_uri(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))))
                transform(rows).write.mode("overwrite").parquet(f"{self.out}/batch={batch}")
            entry = part.withColumn("source_batch", F.when(F.col("state") == "pending", F.lit(batch)).otherwise(F.col("source_batch")))
            self.ledger.record(batch, entry.withColumn("state", F.when(F.col("state") == "deleted", "deleted").otherwise("present")))
            self.ledger.commit(version, batch)
            done.append(batch)
        return done

    def result(self) -> DataFrame:
        """The rows of all committed batches, with the column ``batch``; what a failed run wrote is not seen.

        If rows carry ``source_path``, only those of the present content of each file are given: rows of files that were processed again, or
        that vanished, are left out.
        """
        batches = [b for b in self.ledger.batches() if shared.exists(self.spark, f"{self.out}/batch={b}")]
        if not batches:
            raise ValueError("no batch with records has been committed")
        rows = self.spark.read.option("basePath", self.out).parquet(*[f"{self.out}/batch={b}" for b in batches])
        rows = rows.withColumn("batch", F.col("batch").cast("string"))
        if "source_path" not in rows.columns:
            return rows
        live = self.ledger.entries().select(F.col("path").alias("source_path"), F.col("source_batch").alias("batch"))
        return rows.join(live, ["source_path", "batch"], "left_semi")


def newest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``; the caller's order must end in a unique column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
