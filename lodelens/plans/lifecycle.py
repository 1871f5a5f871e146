"""Storage: generations of the chunk table behind a pointer, the embedding cache, inventory and clean-up.

A writer fills folders of its own and then commits the next version file; readers follow the newest. Nothing is changed in place.
"""

from __future__ import annotations

import time
import uuid
import warnings
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodelens import shared
from lodelens.functions import chunking, paths, text
from lodelens.operators.incremental import change_states
from lodelens.plans import retrieval
from lodelens.sources.files import read_text
from lodelens.sources.ignore import BINARY_ENDS


class ChunkStore:
    """Chunks of one project under ``folder``: rows and postings in buckets of the path, and the commits that say where each bucket lies.

    A write makes new folders for the buckets it touches and commits a version that points to them and to the old ones of all other
    buckets; its cost is that of the touched buckets. Of two writers the second is refused (:class:`lodelens.shared.Conflict`).
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, read_only: bool = False):
        self.spark, self.folder, self.buckets, self.read_only = spark, folder.rstrip("/"), buckets, read_only

    def _version(self) -> tuple[int, dict]:
        return shared.newest(self.spark, f"{self.folder}/commits")

    def head(self) -> dict | None:
        return self._version()[1] or None

    def _read(self, head: dict, kind: str) -> DataFrame:
        """The rows of all buckets, each from the folder that holds it now."""
        by_folder: dict[str, list[int]] = {}
        for bucket, folder in head[kind].items():
            by_folder.setdefault(folder, []).append(int(bucket))
        rows = None
        for folder, held in sorted(by_folder.items()):
            one = self.spark.read.schema(head["schema"][kind]).parquet(f"{self.folder}/{folder}").where(F.col("bucket").isin(held))
            rows = one if rows is None else rows.unionByName(one)
        return rows if rows is not None else self.spark.createDataFrame([], head["schema"][kind])

    def chunks(self) -> DataFrame:
        h = self.head()
        if h is None:
            raise LookupError("nothing is indexed here")
        return self._read(h, "chunks").drop("bucket")

    def postings(self) -> DataFrame:
        """The inverted index; an error where it could not be written (see ``head()["text_index"]``)."""
        h = self.head()
        if not h or not h["text_index"]:
            raise LookupError("there is no text index; search by vectors")
        return self._read(h, "postings").drop("bucket")

    def count(self) -> int:
        return (self.head() or {"rows": 0})["rows"]

    def _bucket(self, head: dict | None):
        return F.pmod(F.xxhash64("rel_path"), F.lit(head["n_buckets"] if head else self.buckets)).cast("int")

    def _publish(self, version: int, head: dict | None, rows: DataFrame, touched: list[int] | None, **more) -> int:
        """Write ``rows`` as the content of the touched buckets (None: of all) and commit."""
        if self.read_only:
            raise PermissionError("this store is read-only")
        generation = (head["generation"] if head else 0) + 1
        name, body = f"chunks_g{generation}-{uuid.uuid4().hex[:8]}", text.search_text("rel_path", "symbol", "language", "content")
        placed = rows.withColumn("bucket", self._bucket(head))
        n = shared.write_buckets(placed, f"{self.folder}/{name}")
        written = self.spark.read.schema(placed.schema).parquet(f"{self.folder}/{name}")
        words, text_index = name.replace("chunks_", "postings_"), True
        try:
            shared.write_buckets(retrieval.postings(written.withColumn("search_text", body), ["bucket", "chunk_id"], "search_text"), f"{self.folder}/{words}")
        except Exception as e:  # the chunks are there; search goes by vectors until the next write
            warnings.warn(f"no text index: {e}", stacklevel=2)
            text_index = False
        every = range(head["n_buckets"] if head else self.buckets)
        kept = {k: {} if touched is None or head is None else {b: f for b, f in head[k].items() if int(b) not in touched} for k in ("chunks", "postings")}
        mine = every if touched is None else touched
        value = {
            "generation": generation, "n_buckets": head["n_buckets"] if head else self.buckets, "indexed_at": int(time.time()),
            "chunks": kept["chunks"] | {str(b): name for b in mine}, "postings": kept["postings"] | ({str(b): words for b in mine} if text_index else {}),
            "text_index": text_index and (touched is None or head is None or head["text_index"]),
            "schema": {"chunks": _ddl(placed), "postings": "chunk_id string, term string, dl int, tf long, bucket int"}, "catalog": None, "had_catalog": bool(head and head.get("had_catalog")), **more,
        }
        if touched is None or head is None:
            value["rows"] = n
        else:
            before = self._read(head, "chunks").where(F.col("bucket").isin(touched)).count()
            value["rows"] = head["rows"] - before + n
        shared.commit_version(self.spark, f"{self.folder}/commits", version + 1, value)
        return value["rows"]

    def create(self, rows: DataFrame, **more) -> int:
        """A full rebuild: the next generation holds exactly these rows; the previous one stays for readers under way."""
        version, head = self._version()
        return self._publish(version, head or None, rows, None, **more)

    def add(self, rows: DataFrame) -> int:
        """Rows of paths that may be there already, beside them."""
        return self.upsert(rows, rows.select("rel_path").where("false"), replace=False)

    def upsert(self, rows: DataFrame, touched: DataFrame, replace: bool = True) -> int:
        """Replace all rows of the touched paths (rel_path), and of those of ``rows``, by ``rows``; columns the table lacks are dropped."""
        version, head = self._version()
        if not head:
            return self._publish(0, None, rows, None)
        names = shared.kept(touched.select("rel_path").unionByName(rows.select("rel_path")).distinct().withColumn("bucket", self._bucket(head)), "touched")
        touched_buckets = [r.bucket for r in names.select("bucket").distinct().collect()]  # at most as many as there are buckets
        old = self._read(head, "chunks").where(F.col("bucket").isin(touched_buckets)).drop("bucket")
        if replace:
            old = old.join(names.select("rel_path"), "rel_path", "left_anti")
        new = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns])
        return self._publish(version, head, old.unionByName(new), touched_buckets)

    def delete_paths(self, paths: DataFrame) -> int:
        return self.upsert(self.chunks().where("false"), paths)

    def reindex_file(self, root: str, rel_path: str, project_id: str = "") -> int:
        """Chunk one file of a source tree anew and replace its rows; a file that is gone, binary or empty loses them.

        A path that leads out of the tree (absolute, by ``..``, or through a link) is an error.
        """
        path = inside(root, rel_path)
        content = read_text(path) if path.is_file() and not path.suffix.lower() in BINARY_ENDS else None
        plain = path.relative_to(Path(root).resolve()).as_posix()
        row = self.spark.createDataFrame([(project_id, plain, content)], "project_id string, rel_path string, content string")
        row = row.where("content IS NOT NULL AND content <> ''").withColumn("language", paths.language("rel_path"))
        chunks = chunking.chunked(row).withColumn("chunk_id", text.chunk_id("rel_path", "ordinal", "text")).withColumnRenamed("text", "content")
        return self.upsert(chunks, self.spark.createDataFrame([(plain,)], "rel_path string"))

    def write_catalog(self, files: DataFrame) -> None:
        """Keep a catalogue (project_id, path, chunks, ...) beside the chunks; refused where its chunks aren't as many as the table's rows.

        Every later write of chunks leaves the store without one (:meth:`health` then says catalog_stale) until it is written again.
        """
        version, head = self._version()
        if self.read_only:
            raise PermissionError("this store is read-only")
        n = files.agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("n")).first()["n"]
        if not head or n != head["rows"]:
            raise ValueError(f"the catalogue counts {n} chunks, the table {head['rows'] if head else 0}")
        name = f"catalog_g{head['generation']}-{uuid.uuid4().hex[:8]}"
        files.write.parquet(f"{self.folder}/{name}")
        shared.commit_version(self.spark, f"{self.folder}/commits", version + 1, head | {"catalog": name, "had_catalog": True})

    def catalog(self) -> DataFrame:
        h = self.head()
        if not h or not h["catalog"]:
            raise LookupError("there is no catalogue of the present chunks")
        return self.spark.read.parquet(f"{self.folder}/{h['catalog']}")

    def _used(self) -> set[str]:
        """Folders that the present version or the one before it refers to."""
        version, head = self._version()
        before = shared.read_json(self.spark, f"{self.folder}/commits/v{version - 1:09d}.json") if version > 1 else None
        return {f for h in (head, before) if h for f in (*h["chunks"].values(), *h["postings"].values(), h["catalog"]) if f}

    def reclaim(self, dry_run: bool = False) -> list[str]:
        """Remove folders that neither the present version nor the one before refers to; gives their names."""
        if self.head() is None:
            return []
        used = self._used()
        old = [n for n in shared.list_folders(self.spark, self.folder) if n != "commits" and n not in used]
        if not dry_run:
            if self.read_only:
                raise PermissionError("this store is read-only")
            for n in old:
                shared.remove(self.spark, f"{self.folder}/{n}")
        return sorted(old)

    def drop(self) -> None:
        if self.read_only:
            raise PermissionError("this store is read-only")
        shared.remove(self.spark, self.folder)

    def storage(self) -> dict:
        """Bytes of the folders the present version refers to, and of the others."""
        fs, p = shared._fs(self.spark, self.folder)
        h, out = self.head(), {"active": 0, "stale": 0}
        used = {f for k in ("chunks", "postings") for f in h[k].values()} | {h["catalog"]} if h else set()
        for name in shared.list_folders(self.spark, self.folder):
            if name != "commits":
                out["active" if name in used else "stale"] += fs.getContentSummary(p.suffix(f"/{name}")).getLength()
        return out

    def health(self, catalog_rows: DataFrame | None = None, root: str | None = None, model: str | None = None, git: dict | None = None, files: DataFrame | None = None, scan: DataFrame | None = None) -> list[str]:
        """Issue codes. Always: not_indexed, table_missing, table_count_mismatch, text_index_missing, catalog_stale. With more given:
        catalog_count_mismatch (chunk ids of a catalogue), root_missing, model_drift (the embedder's name), git_stale (a snapshot of the work tree), and index_stale (the
        files manifest against the present scan)."""
        h, issues = self.head(), []
        if h is None:
            return ["not_indexed"]
        if any(not shared.exists(self.spark, f"{self.folder}/{f}") for f in set(h["chunks"].values())):
            return ["table_missing"]
        if self.chunks().count() != h["rows"]:
            issues.append("table_count_mismatch")
        if not h["text_index"]:
            issues.append("text_index_missing")
        if h.get("had_catalog") and not h["catalog"]:
            issues.append("catalog_stale")
        if catalog_rows is not None:
            ids = self.chunks().select("chunk_id")
            other = catalog_rows.select("chunk_id")
            if not ids.exceptAll(other).isEmpty() or not other.exceptAll(ids).isEmpty():
                issues.append("catalog_count_mismatch")
        if root is not None and not Path(root).is_dir():
            issues.append("root_missing")
        if model is not None and h.get("model") not in (None, model):
            issues.append("model_drift")
        if git is not None and any(h.get("git", {}).get(k) not in (None, git.get(k)) for k in ("worktree", "ref", "commit", "dirty")):
            issues.append("git_stale")
        if files is not None and scan is not None and not change_states(files, scan, ["rel_path"]).where("state <> 'unchanged'").isEmpty():
            issues.append("index_stale")
        return issues


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def inside(root: str, rel_path: str) -> Path:
    """The path of a file below ``root``; an error if it leads out of it."""
    base = Path(root).resolve()
    path = (base / rel_path.replace("\\", "/")).resolve()
    if Path(rel_path).is_absolute() or path == base or base not in path.parents:
        raise ValueError(f"{rel_path!r} leads out of the project")
    return path


def remove_project(spark: SparkSession, home: str, name: str) -> bool:
    """Remove one project's folder below ``home``; whether there was one."""
    if "/" in name or name in ("", ".", ".."):
        raise ValueError(f"{name!r} is no project")
    if not shared.exists(spark, f"{home}/{name}"):
        return False
    shared.remove(spark, f"{home}/{name}")
    return True


def orphans(spark: SparkSession, home: str, roots: dict[str, str], remove: bool = False) -> list[str]:
    """Projects below ``home`` that were never committed, or whose source folder (``roots``, by project) is gone."""
    found = []
    for name in shared.list_folders(spark, home):
        committed = shared.newest(spark, f"{home}/{name}/commits")[0]
        if not committed or (name in roots and not Path(roots[name]).is_dir()):
            found.append(name)
            if remove:
                shared.remove(spark, f"{home}/{name}")
    return sorted(found)


def orphaned_chunks(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """(project_id, rel_path, n): paths with chunks that no succeeded run has in its manifest."""
    c = chunks.where("rel_path IS NOT NULL").groupBy("project_id", "rel_path").agg(F.count_distinct("chunk_id").alias("n")).alias("c")
    on = [F.col("c.project_id").eqNullSafe(F.col("m.project_id")), F.col("c.rel_path") == F.col("m.path")]
    return c.join(manifest.select("project_id", "path").alias("m"), on, "left_anti")


# -- embedding cache ------------------------------------------------------------------------------
def cache_compact(cache: DataFrame) -> DataFrame:
    """One row per hash and length: the one used last; of equals the greatest vector."""
    return cache.where("h IS NOT NULL").groupBy("h", "dim").agg(F.max(F.struct(F.coalesce("last_used_at", F.lit(0.0)).alias("last_used_at"), "vec")).alias("r")).select("h", "dim", "r.vec", "r.last_used_at")


def cache_misses(wanted: DataFrame, cache: DataFrame, dim: int) -> DataFrame:
    """Distinct wanted hashes without a usable vector of that length: what must be embedded."""
    have = cache.where((F.col("dim") == dim) & (F.size("vec") == dim)).select("h")
    return wanted.where("h IS NOT NULL").select("h").distinct().join(have, "h", "left_anti")


def cache_lookup(wanted: DataFrame, cache: DataFrame, dim: int, now: float) -> DataFrame:
    """Wanted hashes with their vectors where cached; ``last_used_at`` becomes now for those."""
    have = cache_compact(cache).where((F.col("dim") == dim) & (F.size("vec") == dim)).select("h", "vec")
    return wanted.select("h").distinct().join(have, "h", "left").withColumn("last_used_at", F.when(F.col("vec").isNotNull(), F.lit(now)))


def cache_put(cache: DataFrame, rows: DataFrame, now: float) -> DataFrame:
    """The cache with new rows (h, dim, vec) in it, last used now; of a key that is there the new vector counts.

    Rows that no lookup could use (null, of another length than ``dim``, or with values that are no numbers) are not put in.
    """
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    new = rows.where(F.col("h").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") == F.col("dim")) & ~bad)
    return cache_compact(cache.select("h", "dim", "vec", "last_used_at").unionByName(new.select("h", "dim", "vec", F.lit(float(now)).alias("last_used_at"))))


def cache_evict(cache: DataFrame, max_bytes: int, bytes_per_value: int = 4, overhead: int = 80) -> DataFrame:
    """What stays within the budget: rows used longest ago go first, of equals the smaller hash.

    The cut is found from one small table of sizes per (last use) range, so no task sorts the whole cache.
    """
    c = cache_compact(cache)
    size = (F.coalesce(F.greatest(F.size("vec"), F.lit(0)), F.lit(0)) * bytes_per_value + overhead).cast("long")
    c = c.withColumn("_size", size)
    total = c.agg(F.sum("_size").alias("b"), F.count("*").alias("n")).first()
    if not total["n"] or total["b"] <= max_bytes:
        return c.drop("_size")
    average = total["b"] / total["n"]
    drop = int(-(-(total["b"] - max_bytes) // average))
    if drop >= total["n"]:
        return c.where("false").drop("_size")
    # the drop-th row in order: by exact counting within the range of last use that holds it
    n = 256
    cuts = sorted(set(c.agg(F.percentile_approx("last_used_at", [i / n for i in range(1, n)], 10_000).alias("q")).first()["q"] or []))
    part = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x < F.col("last_used_at"))) if cuts else F.lit(0)
    c = c.withColumn("_part", part)
    counts = {r["_part"]: r["n"] for r in c.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, at = 0, 0
    for p in sorted(counts):
        if before + counts[p] >= drop:
            at = p
            break
        before += counts[p]
    w = Window.partitionBy("_part").orderBy("last_used_at", "h", "dim")
    edge = c.where(F.col("_part") == at).withColumn("_r", F.row_number().over(w)).where(F.col("_r") > drop - before).drop("_r")
    return c.where(F.col("_part") > at).unionByName(edge).drop("_size", "_part")


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache_compact(cache).groupBy("dim").agg(
        F.count("*").alias("rows"), F.sum(F.greatest(F.coalesce(F.size("vec"), F.lit(0)), F.lit(0)) * 4).cast("long").alias("bytes"), F.round(F.min("last_used_at"), 3).alias("oldest")
    )


# -- inventory and refs ---------------------------------------------------------------------------
def inventory(runs: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """Projects with their newest status, run and start, paged by name."""
    last = F.max(F.struct("logged_at", "run_seq", F.lower(F.trim("status")).alias("status"), "run_id")).alias("r")
    rows = runs.groupBy("project_id").agg(F.count_distinct("run_id").alias("n_runs"), last)
    rows = rows.select("project_id", "n_runs", F.col("r.run_id").alias("run_id"), F.col("r.status").alias("status"))
    return rows.orderBy("project_id").offset(max(0, offset)).limit(max(0, min(limit, 500)))


def resolve_ref(indexes: DataFrame, logical_project: str, ref: str) -> DataFrame:
    """The newest index (indexed_at, then id) of the same logical project for a ref; empty if there is none, never another ref."""
    hit = indexes.where((F.col("logical_project_id") == logical_project) & ((F.col("ref") == ref) | (F.col("commit") == ref) | F.col("commit").startswith(ref)))
    return hit.orderBy(F.desc("indexed_at"), "project_id").limit(1)


def plan_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("project_id", "state").agg(F.count("*").alias("n"))


def plan_totals(states: DataFrame, chunks: DataFrame, cache: DataFrame, dim: int) -> DataFrame:
    """Per project: files to index (added, changed), to remove (deleted), chunks they have now, and hashes among these without a cached vector."""
    s = states.where("state <> 'unchanged'")
    files = s.groupBy("project_id").agg(
        F.count(F.when(F.col("state") != "deleted", 1)).alias("files"), F.count(F.when(F.col("state") == "deleted", 1)).alias("removed")
    )
    todo = s.where("state <> 'deleted'").select("project_id", "rel_path")
    c = chunks.select("project_id", "rel_path", "chunk_id", "chunk_hash").distinct().join(todo, ["project_id", "rel_path"])
    n = c.groupBy("project_id").agg(F.count_distinct("chunk_id").alias("chunks"))
    have = cache.where((F.col("dim") == dim) & (F.size("vec") == dim) & F.col("h").isNotNull()).select(F.col("h").alias("chunk_hash")).distinct()
    missing = c.where("chunk_hash IS NOT NULL").select("project_id", "chunk_hash").distinct().join(have, "chunk_hash", "left_anti").groupBy("project_id").agg(F.count("*").alias("missing_embeddings"))
    return files.join(n, "project_id", "left").join(missing, "project_id", "left").fillna(0, ["chunks", "missing_embeddings"])
