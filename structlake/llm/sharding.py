"""Sharding by size-tiered compaction with a versioned manifest.

Arrivals are appended as small immutable runs (folders of Parquet files). Runs
of a similar size share a tier; as soon as ``fan_in`` runs stand in one, they are
merged into a single run of target-sized files, read and written without a
shuffle. The manifest lists the live runs. A new version is written aside and
committed by a rename that fails where the version exists, so a writer that
loses the race starts again from the newer one and readers see one version or
the other. That needs a store whose rename is atomic (HDFS, local or shared file
systems; not plain object stores). A lost task leaves nothing: Spark commits a
run's files as a whole, and a run counts only once the manifest names it.

Merged runs stay, so older versions stay readable. ``vacuum`` forgets all but the
newest versions and deletes runs that none of these names once they are old enough,
also those of a writer that died before its commit.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass
from time import time
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Run:
    """An immutable run; ``path`` is relative to the store's root."""

    path: str
    rows: int
    bytes: int
    files: int


class ShardStore:
    """Shards under ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 256 << 20, fan_in: int = 4, least_bytes: int = 1 << 20):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fan_in, self.least_bytes = target_bytes, fan_in, least_bytes
        self._jvm = spark._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    # --- manifest -------------------------------------------------------------

    def versions(self) -> list[int]:
        """The committed versions that are still there, oldest first."""
        found = self._fs.listStatus(self._path(f"{self.root}/manifest"))
        names = [s.getPath().getName() for s in found]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def version(self) -> int:
        """The newest committed version; 0 where there is none."""
        return max(self.versions(), default=0)

    def runs(self, version: int | None = None) -> list[Run]:
        """The live runs of a version; an error where it was never made or is forgotten."""
        version = self.version() if version is None else version
        if not version:
            return []
        if version not in self.versions():
            raise ValueError(f"there is no version {version}")
        stream = self._fs.open(self._path(f"{self.root}/manifest/v{version:012d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Run(**r) for r in json.loads(text)["runs"]]

    def commit(self, base: int, runs: list[Run]) -> bool:
        """Make ``runs`` version base + 1; False when another writer was first."""
        temp = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(temp, False)
        out.write(bytearray(json.dumps({"version": base + 1, "runs": [asdict(r) for r in runs]}).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri() if temp.toUri().getScheme() else self._fs.getUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(self._fs.makeQualified(temp), self._fs.makeQualified(self._path(f"{self.root}/manifest/v{base + 1:012d}.json")), options)
        except Exception as e:
            self._fs.delete(temp, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _measured(self, path: str, rows: int) -> Run:
        parts = [s for s in self._fs.listStatus(self._path(f"{self.root}/{path}")) if s.getPath().getName().startswith("part-")]
        return Run(path, rows, sum(s.getLen() for s in parts), len(parts))

    # --- writing --------------------------------------------------------------

    def append(self, arrivals: DataFrame, by: str | None = None) -> list[Run]:
        """Add rows as one run, or as one run for each value of column ``by``.

        Each task writes its rows where they are: no shuffle. An empty frame adds
        no run. All columns of ``arrivals`` stay in the files, ``by`` too.
        """
        name = uuid.uuid4().hex
        place, folder = f"{self.root}/data/{name}", f"_run_{name}"
        if by is None:
            arrivals.write.parquet(place)
            counts = {f"data/{name}": self.spark.read.schema(arrivals.schema).parquet(place).count()}
        else:
            arrivals.withColumn(folder, F.col(by)).write.partitionBy(folder).parquet(place)
            of = F.element_at(F.split("_metadata.file_path", "/"), -2)
            # a row for each new run
            counted = self.spark.read.schema(arrivals.schema).parquet(place).groupBy(of.alias("run")).agg(F.count("*").alias("n")).collect()
            counts = {f"data/{name}/{unquote(r.run)}": r.n for r in sorted(counted)}
        new = [self._measured(p, n) for p, n in counts.items() if n]
        if new:
            while not self.commit(v := self.version(), [*self.runs(v), *new]):
                pass
        return new

    def tier(self, run: Run) -> int:
        return max(0, math.floor(math.log(max(run.bytes, 1) / self.least_bytes, self.fan_in)))

    def compact(self, schema) -> int:
        """Merge until no tier has ``fan_in`` runs; the number of merges.

        The merged runs stay for the versions that name them.
        """
        merges = 0
        while True:
            version = self.version()
            live = self.runs(version)
            tiers: dict[int, list[Run]] = {}
            for run in live:
                tiers.setdefault(self.tier(run), []).append(run)
            full = [sorted(t, key=lambda r: (r.bytes, r.path))[: self.fan_in] for _, t in sorted(tiers.items()) if len(t) >= self.fan_in]
            if not full:
                return merges
            old = full[0]
            files = max(1, math.ceil(sum(r.bytes for r in old) / self.target_bytes))
            place = f"data/{uuid.uuid4().hex}"
            self.spark.read.schema(schema).parquet(*[f"{self.root}/{r.path}" for r in old]).coalesce(files).write.parquet(f"{self.root}/{place}")
            merged = self._measured(place, sum(r.rows for r in old))
            gone = {r.path for r in old}
            if self.commit(version, [*(r for r in live if r.path not in gone), merged]):
                merges += 1
            else:
                self._fs.delete(self._path(f"{self.root}/{place}"), True)

    def orphans(self, versions: list[int] | None = None) -> dict[str, float]:
        """Run folders that none of ``versions`` (by default all) names, and their ages in seconds."""
        named = {r.path for v in (self.versions() if versions is None else versions) for r in self.runs(v)}
        data = self._path(f"{self.root}/data")
        out = {}
        for top in self._fs.listStatus(data) if self._fs.exists(data) else []:
            below = [s for s in self._fs.listStatus(top.getPath()) if s.isDirectory() and s.getPath().getName().startswith("_run_")]
            for run in below or [top]:
                path = f"data/{top.getPath().getName()}" + (f"/{run.getPath().getName()}" if below else "")
                if path not in named:
                    out[path] = time() - run.getModificationTime() / 1000
        return out

    def vacuum(self, versions: int = 10, older_than: float = 86400.0) -> list[str]:
        """Forget all but the newest ``versions``, then delete what none of these names.

        Runs younger than ``older_than`` seconds stay: a writer may be about to commit
        them, or a reader may have planned with them. Gives the deleted runs.
        """
        kept = self.versions()[-versions:]
        for v in self.versions()[: -len(kept)] if kept else []:
            self._fs.delete(self._path(f"{self.root}/manifest/v{v:012d}.json"), False)
        gone = [path for path, age in self.orphans(kept).items() if age >= older_than]
        for path in gone:
            self._fs.delete(self._path(f"{self.root}/{path}"), True)
        return gone

    # --- reading --------------------------------------------------------------

    def read(self, schema, version: int | None = None) -> DataFrame:
        """All rows of a version; no rows where nothing was committed."""
        paths = [f"{self.root}/{r.path}" for r in self.runs(version)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def history(self) -> DataFrame:
        """version, run, tier, rows, bytes, files: the live runs of every version."""
        rows = [(v, r.path, self.tier(r), r.rows, r.bytes, r.files) for v in self.versions() for r in self.runs(v)]
        return self.spark.createDataFrame(rows, "version long, run string, tier int, rows long, bytes long, files int")


def shard(arrivals: DataFrame, root: str, by: str | None = None, **options) -> ShardStore:
    """Append ``arrivals`` (one run a value of ``by``), compact, give the store.

    Rows, repeated or null, are kept as they are. A null in ``by`` is a run of
    its own.
    """
    store = ShardStore(arrivals.sparkSession, root, **options)
    store.append(arrivals, by)
    store.compact(arrivals.schema)
    return store


#: DuckDB's form of the registered query: eight arrivals of like sizes fill at least
#: one tier, so runs become fewer; the first version still holds every row.
SQL = """
SELECT doc_id, ((doc_id % 8) + 8) % 8 AS arrival, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256,
       (SELECT count(DISTINCT doc_id % 8) FROM documents) AS n_arrivals, (SELECT count(DISTINCT doc_id % 8) FROM documents) = 8 AS compacted, true AS first_version_whole
FROM documents
"""
