"""A keyed draw table in files, changed by copy on write.

Rows lie in parts, one for each lottery and period of the date.  A part is a folder
of Parquet files that is never changed; a version of the table is a manifest, a small
JSON file that names the folder of each part.  A keyed write

1. finds the parts that the new rows touch,
2. reads only these, column-pruned for the look-up of known keys, and writes them
   anew beside the old ones: stored rows pass unshuffled (their new rows' keys are
   broadcast while they are under Spark's threshold), only new rows are dealt out,
3. commits by putting the next manifest in place, which names the new folders for the
   touched parts and the old ones for all others.

A writer that dies before step 3 leaves the old version as it was; its files are named
by no manifest, and ``vacuum`` removes them like those of dropped versions.  A manifest
holds the number of the batch it was made from, so a batch that is run again after its
commit changes nothing.  One writer at a time; readers keep the version they opened.

Rows of the first load have no arrival order and lose against any new row; of two new
rows with one key the later arrival (``order``) wins, whichever batch it came in.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.catalog import dedupe_last
from ..session import store

PERIODS = {"decade": lambda d: (F.year(d) / 10).cast("int").cast("string"), "year": lambda d: F.year(d).cast("string"),
           "month": lambda d: F.date_format(d, "yyyyMM")}


@dataclass(frozen=True)
class Snapshot:
    version: int
    batch: int
    parts: dict[str, str] = field(default_factory=dict)     # part -> folder under the root


def part_of(lottery: Column, fecha: Column, period: str) -> Column:
    """Name of a row's part: letters and digits only, so it is a folder name as it stands."""
    name = F.coalesce(F.lower(F.hex(F.encode(lottery.cast("string"), "UTF-8"))), F.lit("none"))
    return F.concat_ws("-", name, F.coalesce(PERIODS[period](fecha), F.lit("none")))


def same_key(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    on = F.lit(True)
    for k in key:
        on = on & a[k].eqNullSafe(b[k])
    return on


class CowTable:
    """The table under ``root`` (see module doc)."""

    def __init__(self, spark: SparkSession, root: str, key=("fecha", "lottery"), order: str = "k", period: str = "year"):
        self.spark, self.root, self.key, self.order, self.period = spark, root, list(key), order, period
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- files ----------------------------------------------------------------

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))

    def _names(self, *folder: str) -> list[str]:
        path = self._path(*folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n[2:-5]) for n in self._names("manifests") if n.startswith("v=") and n.endswith(".json"))

    def _manifest(self, version: int) -> dict:
        stream = self._fs.open(self._path("manifests", f"v={version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def snapshot(self, version: int | None = None) -> Snapshot:
        known = self.versions()
        if not known:
            raise FileNotFoundError(f"no table under {self.root}")
        got = self._manifest(known[-1] if version is None else version)
        return Snapshot(got["version"], got["batch"], got["parts"])

    def _commit(self, snap: Snapshot, schema: StructType) -> None:
        final = self._path("manifests", f"v={snap.version}.json")
        if self._fs.exists(final):
            raise FileExistsError(f"version {snap.version} was committed by another writer")
        draft = self._path("manifests", f".draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps({"version": snap.version, "batch": snap.batch, "parts": snap.parts,
                                           "schema": schema.jsonValue()}).encode()))
        stream.close()
        if not self._fs.rename(draft, final):
            raise OSError(f"version {snap.version} could not be put in place")

    # -- reading --------------------------------------------------------------

    def schema(self) -> StructType:
        return StructType.fromJson(self._manifest(self.versions()[-1])["schema"])

    def _read(self, snap: Snapshot, parts: list[str], spark: SparkSession | None = None) -> DataFrame:
        spark = spark or self.spark
        folders = [f"{self.root}/{snap.parts[p]}" for p in sorted(parts)]
        schema = self.schema()
        return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)

    def read(self, version: int | None = None, lottery: str | None = None) -> DataFrame:
        """A version's rows (the newest one's); of one lottery only its parts are opened."""
        snap = self.snapshot(version)
        mine = None if lottery is None else lottery.encode().hex() + "-"
        out = self._read(snap, [p for p in snap.parts if mine is None or p.startswith(mine)]).drop("_src")
        return out if lottery is None else out.where(F.col("lottery") == lottery)

    # -- writing --------------------------------------------------------------

    def _write(self, rows: DataFrame, batch: int) -> dict[str, str]:
        folder = f"data/b={batch}-{uuid.uuid4().hex}"
        rows.write.partitionBy("part").parquet(f"{self.root}/{folder}")
        return {n[5:]: f"{folder}/{n}" for n in self._names(folder) if n.startswith("part=")}

    def _with_part(self, df: DataFrame) -> DataFrame:
        return df.withColumn("part", part_of(F.col("lottery"), F.col("fecha"), self.period))

    def start(self, initial: DataFrame) -> Snapshot:
        """Version 0: the first rows, known as not streamed."""
        rows = initial.withColumn("_src", F.lit(0))
        snap = Snapshot(0, -1, self._write(self._with_part(rows).hint("rebalance", "part"), -1))
        self._commit(snap, rows.schema)
        return snap

    def plan_merge(self, new: DataFrame, snap: Snapshot) -> tuple[DataFrame, DataFrame, list[str]]:
        """(stored rows that stay, new rows with ``what`` becomes of each, touched parts) of one row per key."""
        touched = [r.part for r in new.select("part").distinct().collect()]     # names of folders
        # in the new rows' session (a micro-batch has its own), where the write's counts are observed
        stored = self._read(snap, [p for p in touched if p in snap.parts], new.sparkSession)
        asked = new.select(*self.key, F.col(self.order).alias("_asked"))
        older = (F.col("_src") == 0) | F.col(self.order).isNull() | (F.col(self.order) <= F.col("_asked"))
        # keys that both sides have; at most the new rows, written so that the planner knows its size
        met = store(stored.join(asked, same_key(stored, asked, self.key)).select(
            *[stored[k] for k in self.key], older.alias("_replaced")), "met-keys")
        replaced = met.where("_replaced")
        stays = stored.join(replaced, same_key(stored, replaced, self.key), "left_anti")
        known = new.join(met, same_key(new, met, self.key), "left").select(
            *[new[c] for c in new.columns], F.when(F.col("_replaced"), "updated").when(~F.col("_replaced"), "stale")
            .otherwise("inserted").alias("what"))
        return stays, known, touched

    def merge(self, batch: DataFrame, batch_id: int, outcome: list | None = None) -> dict[str, int] | None:
        """Upsert of a batch; counts of its rows, or None if the batch was committed before.

        ``outcome`` takes the batch's rows, one per key, with ``what`` became of each.
        """
        snap = self.snapshot()
        if snap.batch >= batch_id:
            return None
        columns = [f for f in self.schema().fieldNames()]
        read = Observation(f"read-{uuid.uuid4().hex}")
        rows = batch.withColumn("_src", F.lit(1)).select(*columns).observe(read, F.count(F.lit(1)).alias("read"))
        new = store(self._with_part(dedupe_last(rows, self.key, [self.order])), "batch")
        if new.isEmpty():                                # nothing was observed
            self._commit(Snapshot(snap.version + 1, batch_id, snap.parts), self.schema())
            return dict.fromkeys(("read", "inserted", "updated", "stale", "affected"), 0)
        stays, known, touched = self.plan_merge(new, snap)
        if outcome is not None:
            known = store(known, "outcome")
            outcome.append(known)
        seen = Observation(f"merge-{uuid.uuid4().hex}")
        fresh = known.observe(seen, *[F.count(F.when(F.col("what") == w, 1)).alias(w) for w in ("inserted", "updated", "stale")])
        out = self._with_part(stays).select(*columns, "part").unionByName(
            fresh.where("what <> 'stale'").select(*columns, "part").hint("rebalance", "part"))
        written = self._write(out, batch_id)
        counts = {**read.get, **seen.get}
        self._commit(Snapshot(snap.version + 1, batch_id, {**snap.parts, **written}), self.schema())
        # as a keyed write reports: every row it was given, and those that made a new key
        return {**counts, "affected": counts["read"]}

    def vacuum(self, keep: int = 1) -> list[str]:
        """Drops all but the newest ``keep`` manifests and every folder that no manifest left names."""
        known = self.versions()
        for v in known[:-keep]:
            self._fs.delete(self._path("manifests", f"v={v}.json"), False)
        used = {folder for v in known[-keep:] for folder in self.snapshot(v).parts.values()}
        gone = []
        for batch in self._names("data"):
            mine = [f"data/{batch}/{n}" for n in self._names("data", batch)]
            if not used.intersection(mine):
                self._fs.delete(self._path("data", batch), True)
                gone.append(f"data/{batch}")
                continue
            for folder in mine:
                if "/part=" in folder and folder not in used:
                    self._fs.delete(self._path(folder), True)
                    gone.append(folder)
        return gone
