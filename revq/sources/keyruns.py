"""Keys of a growing store as bucketed runs, merged level by level.

Each load or epoch adds one run: its keys, in the buckets of an external table
(a partition per run). Every join with the stored keys then reads them already
partitioned by key, so only the new batch is shuffled. When ``fan`` runs of a
level exist they are merged into one run of the next level, bucket by bucket
and without a shuffle; so a bucket has at most ``fan`` files a level, and a
key is rewritten once a level, not once an epoch.

A run counts once its mark exists; the mark names the loads whose keys it
holds. A merged run stands for its inputs from the moment of its mark, and
only then are they removed. So a merge that ends half-way (no mark, or a mark
and inputs still there) neither loses a key nor gives one twice.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revq.sources.files import file_system

KEY = "review_id"


@dataclass(frozen=True)
class Run:
    name: str
    level: int
    loads: frozenset[int]


@dataclass
class KeyRuns:
    spark: SparkSession
    root: str
    buckets: int
    fan: int = 4
    table: str | None = None

    def __post_init__(self):
        self.buckets = self._kept_buckets()
        self.table = self.table or "revq_keys_" + hashlib.md5(self.root.encode()).hexdigest()[:12]
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({KEY} STRING, run STRING) USING parquet PARTITIONED BY (run) "
            f"CLUSTERED BY ({KEY}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/runs'"
        )
        fs, p = file_system(self.spark, f"{self.root}/runs")
        if fs.exists(p):  # the catalog entry may be new while the files are not
            self.spark.sql(f"ALTER TABLE {self.table} RECOVER PARTITIONS")

    def _kept_buckets(self) -> int:
        """The number of buckets that the files were written with; the first program to come sets it."""
        fs, p = file_system(self.spark, f"{self.root}/buckets=*")
        found = fs.globStatus(p)
        if found:
            return int(found[0].getPath().getName().split("=")[1])
        fs, p = file_system(self.spark, f"{self.root}/buckets={self.buckets}")
        fs.mkdirs(p)
        return self.buckets

    # ------------------------------------------------------------------ marks
    def committed(self) -> list[Run]:
        """Runs with a mark: one listing, a few small files."""
        fs, p = file_system(self.spark, f"{self.root}/done")
        if not fs.exists(p):
            return []
        read = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString
        out = []
        for status in fs.listStatus(p):
            stream = fs.open(status.getPath())
            try:
                loads = read(stream, "UTF-8")
            finally:
                stream.close()
            name = status.getPath().getName()
            if loads.endswith(";"):  # a mark cut short does not count
                out.append(Run(name, int(name[1:].split("-")[0]), frozenset(int(n) for n in loads[:-1].split(","))))
        return out

    def live(self) -> list[Run]:
        """The fewest committed runs that hold every load once: a merged run stands for its inputs."""
        out: list[Run] = []
        for run in sorted(self.committed(), key=lambda r: (-len(r.loads), r.name)):
            if not any(run.loads <= kept.loads for kept in out):
                out.append(run)
        return out

    def loads(self) -> set[int]:
        return {n for run in self.live() for n in run.loads}

    # ------------------------------------------------------------------- runs
    def add(self, load: int, rows: DataFrame) -> None:
        """Keys of one load as a run of level 0; a load that is held already changes nothing."""
        if load in self.loads():
            return
        self._write(f"L0-{load}", rows.select(KEY).distinct(), {load})

    def compact(self) -> None:
        """Merge the oldest ``fan`` runs of a level while there are so many; remove what a merged run stands for."""
        while True:
            level = {}
            for run in self.live():
                level.setdefault(run.level, []).append(run)
            full = [n for n, runs in level.items() if len(runs) >= self.fan]
            if not full:
                break
            some = sorted(level[min(full)], key=lambda r: min(r.loads))[: self.fan]
            loads = frozenset().union(*(r.loads for r in some))
            # distinct keeps the buckets: each task reads its bucket of all inputs and writes one file
            self._write(f"L{min(full) + 1}-{min(loads)}-{max(loads)}-{len(loads)}", self._read(some).distinct(), loads)
        self.sweep()

    def sweep(self) -> None:
        """Remove runs that another run stands for: first the mark, then the files."""
        keep = {run.name for run in self.live()}
        for run in self.committed():
            if run.name not in keep:
                for path in (f"{self.root}/done/{run.name}", f"{self.root}/runs/run={run.name}"):
                    fs, p = file_system(self.spark, path)
                    fs.delete(p, True)
                self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS PARTITION (run = '{run.name}')")

    def _write(self, name: str, rows: DataFrame, loads: set[int] | frozenset[int]) -> None:
        fs, p = file_system(self.spark, f"{self.root}/runs/run={name}")
        fs.delete(p, True)  # what an attempt without a mark left
        self.spark.sql(f"INSERT INTO {self.table} PARTITION (run = '{name}') SELECT {KEY} FROM {{rows}}", rows=rows)
        self._mark(name, loads)

    def _mark(self, name: str, loads: set[int] | frozenset[int]) -> None:
        fs, p = file_system(self.spark, f"{self.root}/done/{name}")
        out = fs.create(p, True)
        out.write(bytearray((",".join(map(str, sorted(loads))) + ";").encode()))
        out.close()

    def _read(self, runs: list[Run]) -> DataFrame:
        return self.spark.table(self.table).filter(F.col("run").isin([r.name for r in runs])).select(KEY)

    def keys(self, exclude: int | None = None) -> DataFrame:
        """All stored keys but those of a load that is its own run; read bucket by bucket, without an exchange."""
        return self._read([r for r in self.live() if r.loads != {exclude}])
