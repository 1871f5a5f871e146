"""Items that appear together: an incremental pair table with association scores.

Method. The state of every basket (here: the files of one commit) is kept, merged from all its deliveries, so it doesn't depend on how
deliveries fall into batches. A batch is compared with the states of its own baskets; each basket that thereby appears, changes
or goes emits *signed* deltas: +1 for each pair, item and basket of its new contents, -1 for those of its old contents. Deltas are
summed and appended to counts that are hash-bucketed on disk, and scores are recomputed for the groups (projects) the
batch touched.

Scale. A table is a sequence of runs, one a batch, each in folders by bucket (:data:`RUNS`); a reader sums over the runs. A run
is merged with the one before it once it has grown to its size, so a row is rewritten a logarithmic number of times and a
batch costs what it holds, not what is there already. Baskets lie in buckets of (group, basket), counts in buckets of the group: a batch
reads the buckets of its baskets, scores of some groups read those groups' buckets. A bucket that holds much (a group with a third
of all rows, say) is written by several tasks (rebalanced at run time). Pairs exist only inside one basket of at most
``max_items`` items; the sum over them combines before its shuffle, so a pair found in a third of all baskets arrives as
one row a task.

An item travels as a hash of (group, item), a pair as two. Different items of one hash are told apart exactly: all but the first get
another hash, and those exceptions (expected: none below some billion items) are part of the committed state.

Failures. A batch writes folders of its own and commits by creating the next version file; until then nothing refers to them. Of two
writers the second is refused. A batch identifier that is already committed is skipped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodelens import shared
from lodelens.functions import paths

#: The tables of the state: key columns, and the columns that hash to the bucket.
RUNS = {
    "baskets": (["grp", "basket"], ["grp", "basket"]),
    "items": (["grp", "item"], ["grp"]),
    "groups": (["grp"], ["grp"]),
    "pairs": (["a", "b"], ["grp"]),
}
COLUMNS = {
    "baskets": "grp string, basket string, epoch int, n_parents int, items array<string>, bucket int",
    "items": "grp string, item string, n long, bucket int",
    "groups": "grp string, n long, bucket int",
    "pairs": "a long, b long, n long, bucket int",
}


def plain_path(c: Column) -> Column:
    """``\\`` to ``/``, without outer blanks and slashes and leading ``./``; null if nothing is left."""
    bare = F.when(c.isNotNull(), paths.plain(c))
    return F.when((bare != "") & (bare != "."), bare)


def deliveries(commits: DataFrame) -> DataFrame:
    """Rows (grp, basket, n_parents, items) from commits: distinct non-null plain paths in order. Null parents are none.

    Null, empty and blank paths don't count; commits without an identifier or project give no rows.
    """
    items = F.array_sort(F.array_distinct(F.filter(F.transform("paths.path", plain_path), lambda p: p.isNotNull())))
    n_parents = F.coalesce(F.size(F.array_compact("parents")), F.lit(0))
    rows = shared.spread(commits.where(F.col("project_id").isNotNull() & F.col("commit").isNotNull()).select("project_id", "commit", "parents", "paths"))
    return rows.select(
        F.col("project_id").alias("grp"), F.col("commit").alias("basket"), F.greatest(n_parents, F.lit(0)).alias("n_parents"),
        F.coalesce(items, F.array().cast("array<string>")).alias("items"),
    )


class PairCounts:
    """The persistent pair table under ``folder`` (on storage all executors share).

    A basket's state is the greatest item list and the greatest number of parents among its deliveries; it counts if it has at most
    ``max_parents`` parents and 1 to ``max_items`` items. ``bits`` is the length of the items' hashes.
    """

    def __init__(self, spark: SparkSession, folder: str, max_items: int = 50, max_parents: int = 1, bits: int = 64):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.max_items, self.max_parents, self.bits = max_items, max_parents, bits

    # -- state ----------------------------------------------------------------------------------
    def _head(self) -> tuple[int, dict]:
        version, head = shared.newest(self.spark, f"{self.folder}/head")
        if not version:
            buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            head = {"batches": [], "buckets": buckets, "exceptions": [], "runs": {t: [] for t in RUNS}}
        return version, head

    def _runs(self, table: str, runs: list[dict], buckets: list[int] | None = None) -> DataFrame:
        """The rows of some runs of one table, of some buckets only if given."""
        df = None
        for r in runs:
            one = self.spark.read.schema(COLUMNS[table]).parquet(f"{self.folder}/{r['name']}")
            df = one if df is None else df.unionByName(one)
        return df if buckets is None else df.where(F.col("bucket").isin(buckets))

    @staticmethod
    def _summed(table: str, rows: DataFrame) -> DataFrame:
        """Runs of one table merged: counts are summed and zeros dropped, of a basket's states the last epoch's greatest stay."""
        keys = RUNS[table][0]
        if table == "baskets":
            return PairCounts._states(rows)
        return rows.groupBy("bucket", *keys).agg(F.sum("n").alias("n")).where("n <> 0")

    @staticmethod
    def _states(rows: DataFrame) -> DataFrame:
        return (
            rows.groupBy("bucket", "grp", "basket")
            .agg(F.max(F.struct("epoch", "n_parents")).alias("p"), F.max(F.struct("epoch", "items")).alias("i"))
            .select("bucket", "grp", "basket", "p.epoch", "p.n_parents", "i.items")
        )

    def _table(self, head: dict, name: str, buckets: list[int] | None = None) -> DataFrame:
        runs = head["runs"][name]
        rows = self._runs(name, runs, buckets)
        return rows if len(runs) == 1 else self._summed(name, rows)

    def _write(self, table: str, rows: DataFrame) -> dict:
        """A run of ``table``; its folders are buckets, a large one written by several tasks, small ones by one."""
        name = f"{table}-{uuid.uuid4().hex[:12]}"
        return {"name": name, "rows": shared.write_buckets(rows, f"{self.folder}/{name}")}

    def _appended(self, table: str, runs: list[dict], run: dict) -> list[dict]:
        """The runs with one more; the last two are merged as long as the last has grown to the one before."""
        runs = [*runs, run]
        while len(runs) > 1 and runs[-1]["rows"] >= runs[-2]["rows"]:
            last = self._runs(table, runs[-2:])
            runs = [*runs[:-2], self._write(table, self._summed(table, last))]
        return [r for r in runs if r["rows"]] or runs[-1:]

    # -- update ---------------------------------------------------------------------------------
    def update(self, baskets: DataFrame, batch: str, withdrawn: DataFrame | None = None) -> DataFrame | None:
        """Merge a batch of deliveries (grp, basket, n_parents, items: sorted distinct non-null); give the groups it touched.

        ``n_parents`` may be missing. Several rows of a basket, in one batch or in several, are deliveries of the same basket.
        ``withdrawn`` (grp, basket) are removed first, with all their earlier deliveries. A batch already committed changes nothing and
        gives None. An empty batch is committed and touches nothing.
        """
        version, head = self._head()
        if batch in head["batches"]:
            return None
        n = head["buckets"]
        at = F.pmod(F.xxhash64("grp", "basket"), F.lit(n)).cast("int").alias("bucket")
        parents = F.col("n_parents") if "n_parents" in baskets.columns else F.lit(0)
        new = baskets.select(at, "grp", "basket", F.lit(0).alias("epoch"), parents.cast("int").alias("n_parents"), "items")
        new = self._states(new).withColumn("gone", F.lit(False))
        if withdrawn is not None:
            empty = F.array().cast("array<string>").alias("items")
            new = new.unionByName(withdrawn.select(at, "grp", "basket", F.lit(0).alias("epoch"), F.lit(0).alias("n_parents"), empty, F.lit(True).alias("gone")).distinct())
        if not head["runs"]["baskets"]:
            # nothing is there yet: every state is new
            states = new.where("NOT gone").select("bucket", "grp", "basket", "epoch", "n_parents", "items")
            path = shared.fresh_path(self.spark, "states")
            states.write.parquet(path)
            states = self.spark.read.schema(states.schema).parquet(path)
            signed = states.where(self._counts("n_parents", "items")).select("grp", "items", F.lit(1).alias("sign"))
        else:
            states, signed, path = self._compared(head, new)
        gb = F.pmod(F.xxhash64("grp"), F.lit(n)).cast("int").alias("bucket")
        runs = {t: list(r) for t, r in head["runs"].items()}

        def append(table: str, rows: DataFrame) -> dict:
            run = self._write(table, rows)
            runs[table] = self._appended(table, runs[table], run)
            return run

        append("baskets", states.select("bucket", "grp", "basket", "epoch", "n_parents", "items"))
        append("groups", signed.groupBy(gb, "grp").agg(F.sum("sign").cast("long").alias("n")).where("n <> 0"))
        items = signed.select("grp", F.explode("items").alias("item"), "sign").groupBy(gb, "grp", "item").agg(F.sum("sign").cast("long").alias("n"))
        run = append("items", items)  # zeros stay: an item keeps its hash once it has one
        exceptions = self._exceptions(head["exceptions"], head["runs"]["items"], run)

        # every item with those after it in path order: two generators, no array of pairs is built
        hashed = F.transform("items", lambda i: self._hash(F.col("grp"), i, exceptions))
        left = signed.where("size(items) > 1").select(gb, hashed.alias("hs"), "sign").select("bucket", F.posexplode("hs").alias("i", "a"), "hs", "sign")
        pairs = left.select("bucket", "a", F.explode(F.expr("slice(hs, i + 2, size(hs))")).alias("b"), "sign").groupBy("bucket", "a", "b")
        append("pairs", pairs.agg(F.sum("sign").cast("long").alias("n")).where("n <> 0"))

        head = head | {"batches": [*head["batches"], batch], "exceptions": exceptions, "runs": runs}
        shared.commit_version(self.spark, f"{self.folder}/head", version + 1, head)
        self._sweep(version)
        return signed.select("grp").distinct()

    def _counts(self, parents: str, items: str) -> Column:
        return (F.col(parents) <= self.max_parents) & F.size(items).between(1, self.max_items)

    def _compared(self, head: dict, new: DataFrame) -> tuple[DataFrame, DataFrame, str]:
        """New states of the batch's baskets, and the signed item lists that lead from the old ones to them.

        Only the buckets the batch touches are read, and of those only the baskets it names are aggregated.
        """
        new = shared.kept(new, "batch")
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most as many as there are buckets
        old = self._runs("baskets", head["runs"]["baskets"], touched).withColumn("is_old", F.lit(True)).withColumn("gone", F.lit(False))
        keys = ["bucket", "grp", "basket"]
        old = old.join(new.select(*keys).distinct(), keys, "left_semi")
        both = old.unionByName(new.withColumn("is_old", F.lit(False)))

        def greatest(column: str, old_rows: bool) -> Column:
            row = F.struct("epoch", column) if old_rows else F.struct(F.lit(0).alias("epoch"), column)
            mine = F.col("is_old") if old_rows else ~F.col("is_old") & ~F.col("gone")
            return F.max(F.when(mine, row))

        j = both.groupBy(*keys).agg(
            greatest("n_parents", True).alias("op"), greatest("items", True).alias("oi"), greatest("n_parents", False).alias("np"),
            greatest("items", False).alias("ni"), F.max("gone").alias("gone"),
        )
        none = F.array().cast("array<string>")
        was = j.withColumn("epoch", F.coalesce("op.epoch", F.lit(0)) + F.col("gone").cast("int"))
        keep = ~F.col("gone")
        state = was.select(
            *keys, "epoch",
            F.greatest(F.when(keep, F.coalesce("op.n_parents", F.lit(0))).otherwise(0), F.coalesce("np.n_parents", F.lit(0))).alias("n_parents"),
            F.greatest(F.when(keep, F.coalesce("oi.items", none)).otherwise(none), F.coalesce("ni.items", none)).alias("items"),
            F.coalesce("op.n_parents", F.lit(0)).alias("old_parents"), F.coalesce("oi.items", none).alias("old_items"), F.col("op").isNotNull().alias("known"),
        )
        path = shared.fresh_path(self.spark, "states")
        state.write.parquet(path)
        state = self.spark.read.schema(state.schema).parquet(path)
        before = F.when(self._counts("old_parents", "old_items"), F.col("old_items")).otherwise(none)
        after = F.when(self._counts("n_parents", "items"), F.col("items")).otherwise(none)
        signed = (
            state.select("grp", before.alias("before"), after.alias("after")).where("before <> after")
            .select("grp", F.inline(F.array(F.struct(F.col("after").alias("items"), F.lit(1).alias("sign")), F.struct(F.col("before").alias("items"), F.lit(-1).alias("sign")))))
            .where("size(items) > 0")
        )
        changed = state.where("NOT known OR items <> old_items OR n_parents <> old_parents OR epoch > 0").drop("old_parents", "old_items", "known")
        return changed, signed, path

    # -- hashes of items ------------------------------------------------------------------------
    def _plain_hash(self, grp: Column, item: Column, again: int = 0) -> Column:
        h = F.xxhash64(F.lit(again), grp, item)
        return h if self.bits == 64 else F.pmod(h, F.lit(1 << self.bits))

    def _hash(self, grp: Column, item: Column, exceptions: list) -> Column:
        h = self._plain_hash(grp, item)
        if not exceptions:
            return h
        pairs = [x for g, i, v in exceptions for x in (F.lit(f"{len(g)}:{g}{i}"), F.lit(v).cast("long"))]
        return F.coalesce(F.element_at(F.create_map(*pairs), F.concat(F.length(grp), F.lit(":"), grp, item)), h)

    def _exceptions(self, known: list, before: list[dict], run: dict) -> list:
        """The exceptions with those of the items of ``run`` added: of items of one hash in a bucket the first keeps it, the others get a free one."""
        if not run["rows"]:
            return known
        h = self._hash(F.col("grp"), F.col("item"), known).alias("h")
        fresh = self._runs("items", [run]).select("bucket", h, "grp", "item", F.lit(False).alias("old"))
        every = fresh
        if before:
            buckets = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most as many as there are buckets
            every = every.unionByName(self._runs("items", before, buckets).select("bucket", h, "grp", "item", F.lit(True).alias("old")))
        who = F.struct("grp", "item")
        clash = every.groupBy("bucket", "h").agg(F.min(who).alias("lo"), F.max(who).alias("hi")).where("lo <> hi").select("bucket", "h")
        if clash.isEmpty():
            return known
        # as many rows as hashes clash
        rows = every.join(clash, ["bucket", "h"], "left_semi").groupBy("bucket", "h", "grp", "item").agg(F.max("old").alias("old")).collect()
        out, taken, held = list(known), {v for _, _, v in known}, set()
        for r in sorted(rows, key=lambda r: (r.bucket, r.h, not r.old, r.grp, r["item"])):
            if (r.bucket, r.h) in held:
                out.append([r.grp, r["item"], self._free(r.grp, r["item"], taken, every)])
                taken.add(out[-1][2])
            held.add((r.bucket, r.h))
        return out

    def _free(self, grp: str, item: str, taken: set, items: DataFrame) -> int:
        """A hash that no other item has."""
        if self.bits < 64:
            return (1 << self.bits) + len(taken)
        again = 1
        while True:
            value = self.spark.range(1).select(self._plain_hash(F.lit(grp), F.lit(item), again)).first()[0]
            if value not in taken and items.where(F.col("h") == value).isEmpty():
                return value
            again += 1

    def _sweep(self, version: int) -> None:
        """Remove run folders that neither the version before nor a later one refers to."""
        used = set()
        for v in (version, version + 1):
            head = shared.read_json(self.spark, f"{self.folder}/head/v{v:09d}.json") or {"runs": {}}
            used |= {r["name"] for runs in head["runs"].values() for r in runs}
        for name in shared.list_folders(self.spark, self.folder):
            if name.split("-")[0] in RUNS and name not in used:
                shared.remove(self.spark, f"{self.folder}/{name}")

    # -- scores ---------------------------------------------------------------------------------
    def scores(self, touched: DataFrame | None = None, min_support: int = 1, min_lift: float = 0.0) -> DataFrame:
        """(grp, item_a, item_b, support, n_a, n_b, n_groups, lift, pmi) of pairs, of touched groups only if given.

        ``lift = support * N / (n_a * n_b)``, N being the group's baskets. Before any batch: no rows.
        """
        version, head = self._head()
        if not version or not head["runs"]["pairs"]:
            return self.spark.createDataFrame(
                [], "grp string, item_a string, item_b string, support long, n_a long, n_b long, n_baskets long, lift double, pmi double"
            )
        buckets = None
        if touched is not None:
            touched = touched.select("grp").distinct()
            at = touched.select(F.pmod(F.xxhash64("grp"), F.lit(head["buckets"])).cast("int").alias("b")).distinct()
            buckets = [r.b for r in at.collect()]  # at most as many as there are buckets
        pairs = self._table(head, "pairs", buckets).where(F.col("n") >= min_support)
        # an item rarer than the support is in no such pair
        items = self._table(head, "items", buckets).where(F.col("n") >= max(1, min_support))
        groups = self._table(head, "groups", buckets)
        if touched is not None:
            items = items.join(touched, "grp", "left_semi")
        items = items.withColumn("h", self._hash(F.col("grp"), F.col("item"), head["exceptions"]))
        a = items.join(groups.select("grp", F.col("n").alias("n_baskets")), "grp").select(
            "bucket", "grp", F.col("item").alias("item_a"), F.col("h").alias("a"), F.col("n").alias("n_a"), "n_baskets"
        )
        b = items.select("bucket", F.col("item").alias("item_b"), F.col("h").alias("b"), F.col("n").alias("n_b"))
        lift = F.col("support") * F.col("n_baskets") / (F.col("n_a") * F.col("n_b"))
        return (
            pairs.select("bucket", "a", "b", F.col("n").alias("support"))
            .join(a, ["bucket", "a"])
            .join(b, ["bucket", "b"])
            .withColumn("lift", lift)
            .where(F.col("support") * F.col("n_baskets") >= min_lift * F.col("n_a") * F.col("n_b"))
            .withColumn("pmi", F.log2("lift"))
            .select("grp", "item_a", "item_b", "support", "n_a", "n_b", "n_baskets", "lift", "pmi")
        )


def co_changes(commits: DataFrame, min_support: int = 5, min_lift: float = 3.0, max_items: int = 50, late: float = 0.1) -> DataFrame:
    """Pairs of files that change together, through a pair table that starts empty.

    The rows come in two batches, as they would from a running system: those loaded first, and the last share ``late`` of them by
    ``loaded_at`` (rows without it come first). Without that column there is one batch. How rows are dealt to batches doesn't matter.
    """
    spark = commits.sparkSession
    counts = PairCounts(spark, shared.fresh_path(spark, "pairs"), max_items)
    cut = None
    if "loaded_at" in commits.columns and late > 0:
        cut = commits.agg(F.percentile_approx(F.unix_micros("loaded_at"), 1 - late, 1000).alias("c")).first()["c"]
    if cut is None:
        counts.update(deliveries(commits), "all")
    else:
        is_late = F.coalesce(F.unix_micros("loaded_at") > cut, F.lit(False))
        counts.update(deliveries(commits.where(~is_late)), "first")
        counts.update(deliveries(commits.where(is_late)), "late")
    return counts.scores(min_support=min_support, min_lift=min_lift)
