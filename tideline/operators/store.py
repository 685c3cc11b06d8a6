"""The vintage store in shared storage: rows replaced by key, sorted files with statistics, and one pointer that is switched last.

A store has folders of Parquet files and numbered manifests. A manifest names the folders that count, each with its source and vintage days; the highest number is the store's
state. A write adds folders and then a manifest, so a reader sees all of a write or nothing, and tasks that are lost or run twice do no harm. Within a folder rows are dealt by ranges of
series, period and vintage and sorted by them, so that a read of one series skips what its files' statistics rule out; days are chosen in the manifest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import drop_folder, staged
from .vintages import STORE, as_of, history

KEY = ["source", "series_id", "period", "vintage_date"]
REQUIRED = ("series_id", "period", "period_unit", "value")
#: Rows of a file, about: 100 MB or so.
FILE_ROWS = 5_000_000


class VintageStore:
    """The store at a path of shared storage. One writer at a time: a second one that ends first makes the other's write fail."""

    def __init__(self, spark: SparkSession, path: str, file_rows: int = FILE_ROWS):
        self.spark, self.path, self.file_rows = spark, path.rstrip("/"), file_rows

    def write(self, source: str, observations: DataFrame, day) -> int:
        """Writes observations of a source as known at day and returns how many; rows of the same series, period and day are replaced, all others stay.

        Of rows with one key that with the largest value stays (then unit of the period, unit, metadata). Missing units and metadata are null. No rows: nothing is written. A missing column raises ValueError.
        """
        return self._merge(observations.withColumns({"source": F.lit(source), "vintage_date": F.lit(day).cast("date")}), REQUIRED)

    def load_history(self, rows: DataFrame) -> int:
        """Writes a history of many sources and days in one job, by the same rule, and returns how many rows; those without a source, series, period or day are left out."""
        return self._merge(rows, (*REQUIRED, "source", "vintage_date"))

    def _merge(self, rows: DataFrame, required: tuple[str, ...]) -> int:
        if missing := [c for c in required if c not in rows.columns]:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        full = rows.withColumns({c: F.lit(None).cast("string") for c in ("unit", "metadata") if c not in rows.columns})
        typed = full.select(*(F.col(f.name).cast(f.dataType) for f in STORE)).na.drop(subset=KEY)
        once = staged(typed.groupBy(*KEY).agg(F.max(F.struct("value", "period_unit", "unit", "metadata")).alias("r")).select(*KEY, "r.*"), "vintages")
        days = once.groupBy("source", "vintage_date").count().collect()  # a row for each source and day that is written
        if not days:
            return 0
        number, entries = self._entries()
        written: dict[str, set[str]] = {}
        for r in days:
            written.setdefault(r["source"], set()).add(str(r["vintage_date"]))
        touched = [e for e in entries if written.get(e["source"], set()) & set(e["days"])]
        # each touched folder is written anew; other days of a source go together by year
        place = {(e["source"], d): e["path"] for e in touched for d in e["days"]}
        new = once
        if touched:
            old = self._rows(touched).join(once.select(*KEY), KEY, "left_anti")
            new = new.unionByName(old)
        units = sorted({(s, d, place.get((s, d), f"{s}/{d[:4]}")) for s, own in {**{e["source"]: set() for e in touched}, **written}.items() for d in own | {d for e in touched if e["source"] == s for d in e["days"]}})
        names = {u: i for i, u in enumerate(sorted({u for _, _, u in units}))}
        n = sum(r["count"] for r in days) + sum(e["rows"] for e in touched)
        added = self._write(new, [(s, d, names[u]) for s, d, u in units], n)
        self._commit(number + 1, [e for e in entries if e not in touched] + added)
        return sum(r["count"] for r in days)

    def _write(self, rows: DataFrame, units: list[tuple[str, str, int]], n: int) -> list[dict]:
        """Writes rows in folders by unit of their source and day, and returns what the manifest says of them."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        by_day = F.broadcast(self.spark.createDataFrame(units, "source string, day string, part int").select("source", F.col("day").cast("date").alias("vintage_date"), "part"))  # a row for each day of what is written
        order = ["part", "series_id", "period", "vintage_date"]
        dealt = rows.join(by_day, ["source", "vintage_date"]).repartitionByRange(max(1, -(-n // self.file_rows)), *order).sortWithinPartitions(*order)
        dealt.select(*STORE.fieldNames(), "part").write.partitionBy("part").parquet(folder)
        counts = self.spark.read.schema(T.StructType([*STORE, T.StructField("part", T.IntegerType())])).parquet(folder).groupBy("part", "source", "vintage_date").count().collect()
        out: dict[int, dict] = {}
        for r in counts:
            e = out.setdefault(r["part"], {"source": r["source"], "path": f"{folder}/part={r['part']}", "rows": 0, "days": []})
            e["rows"] += r["count"]
            e["days"].append(str(r["vintage_date"]))
        return [e | {"days": sorted(e["days"])} for _, e in sorted(out.items())]

    def _files(self, folder: str):
        """(Hadoop's file system, its path class) of a folder."""
        kind = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return kind(folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), kind

    def _entries(self) -> tuple[int, list[dict]]:
        """(number of the last manifest, what it says); 0 and nothing for a new store."""
        folder = f"{self.path}/manifests"
        files, at = self._files(folder)
        if not files.exists(at(folder)):
            return 0, []
        names = [s.getPath().getName() for s in files.listStatus(at(folder))]
        number = max((int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit()), default=0)
        if not number:
            return 0, []
        stream = files.open(at(f"{folder}/{number:012d}.json"))
        try:
            return number, json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, number: int, entries: list[dict]) -> None:
        """Makes these entries the state of the store. The manifest is written whole under another name first; if there is one of that number already, RuntimeError is raised."""
        folder = f"{self.path}/manifests"
        files, at = self._files(folder)
        files.mkdirs(at(folder))
        draft, final = at(f"{folder}/_{uuid.uuid4().hex}"), at(f"{folder}/{number:012d}.json")
        stream = files.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(entries).encode()))
        finally:
            stream.close()
        if files.exists(final) or not files.rename(draft, final):
            files.delete(draft, False)
            raise RuntimeError(f"another writer has made state {number} of {self.path}")

    def _rows(self, entries: list[dict]) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], STORE)
        return self.spark.read.schema(STORE).parquet(*(e["path"] for e in entries))

    def read(self, source: str | None = None, until=None) -> DataFrame:
        """All rows, or those of a source, or those known at a day: other sources' and later days' folders aren't opened."""
        last = "9999-12-31" if until is None else str(until)[:10]
        entries = [e for e in self._entries()[1] if source in (None, e["source"]) and e["days"][0] <= last]
        rows = self._rows(entries)
        if source is not None:
            rows = rows.where(F.col("source") == source)
        return rows if until is None else rows.where(F.col("vintage_date") <= F.lit(last).cast("date"))

    def read_as_of(self, source: str, day=None) -> DataFrame:
        """The latest vintage of each series and period of a source; without a day, of all vintages."""
        return as_of(self.read(source, day), day or "9999-12-31", ["source", "series_id", "period"])

    def history(self, source: str, series_id: str) -> DataFrame:
        """All vintages of a series by period and day: its range of the sorted files only."""
        return history(self.read(source).where(F.col("series_id") == series_id))

    def compact(self, source: str) -> int:
        """Puts the folders of a source together by year of their days, and returns how many are left; the rows stay the same. Readers of the old folders aren't disturbed."""
        number, entries = self._entries()
        own = [e for e in entries if e["source"] == source]
        years: dict[str, list[dict]] = {}
        for e in own:
            years.setdefault(e["days"][0][:4], []).append(e)
        many = [e for group in years.values() if len(group) > 1 for e in group]
        if not many:
            return len(own)
        names = {year: i for i, year in enumerate(sorted(years))}
        units = [(source, d, names[e["days"][0][:4]]) for e in many for d in e["days"]]
        added = self._write(self._rows(many), units, sum(e["rows"] for e in many))
        self._commit(number + 1, [e for e in entries if e not in many] + added)
        return len(own) - len(many) + len(added)

    def vacuum(self) -> int:
        """Deletes what no longer counts: folders that the last manifest doesn't name, and older manifests; returns how many folders. Not while anyone reads an older state or writes."""
        number, entries = self._entries()
        named = {e["path"] for e in entries}
        files, at = self._files(self.path)
        gone = 0
        if not files.exists(at(f"{self.path}/data")):
            return 0
        for written in files.listStatus(at(f"{self.path}/data")):
            folder = f"{self.path}/data/{written.getPath().getName()}"
            units = [f"{folder}/{u.getPath().getName()}" for u in files.listStatus(at(folder)) if u.isDirectory()]
            stale = [u for u in units if u not in named]
            gone += len(stale)
            for u in [folder] if len(stale) == len(units) else stale:
                drop_folder(self.spark, u)
        for manifest in files.listStatus(at(f"{self.path}/manifests")):
            if manifest.getPath().getName() != f"{number:012d}.json":
                files.delete(manifest.getPath(), False)
        return gone
