"""A store of immutable shards with size-tiered compaction, with DataFrame functions only.

Each arrival is appended as a run: a folder of small Parquet files that is never
changed. A version of the store is a manifest that lists runs. Compaction takes
the runs of a size tier, once there are ``fanout`` of them, and rewrites them as
one run of target-sized files; larger runs wait for others of their own size, so
a row is rewritten about once for each tier. A run's files are written before
the manifest that names them, and a manifest appears by one rename that fails if
that version is there already: then the change is made again on top of the
newer version. Readers keep the version they have opened; ``vacuum`` removes
runs that no kept version names. A job that dies leaves unnamed files at most.

An arrival that was appended before, by its name, is not appended again; one
whose name is null or empty is an error. Rows are kept as they are: nulls,
repeated rows and any further columns. An empty arrival leaves no run.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a file that compaction aims at, and how many runs of a tier it takes.
TARGET_BYTES = 128 << 20
FANOUT = 4
ARRIVAL = "streamwin_arrival"
#: Fixed value: the folder name that Spark gives to a null or empty partition value.
NAMELESS = "__HIVE_DEFAULT_PARTITION__"
#: Hours after which files that no manifest names are taken for those of a dead job.
ORPHAN_HOURS = 24.0


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.target_bytes, self.fanout = spark, root.rstrip("/"), target_bytes, fanout
        jvm = spark._jvm.org.apache.hadoop
        self._path = jvm.fs.Path
        self._fs = jvm.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._files = jvm.fs.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())
        self._exists = jvm.fs.FileAlreadyExistsException

    # -- manifests ---------------------------------------------------------

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifests/v{version:010d}.json"

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:11]) for n in names if n[:1] == "v" and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """A version's manifest, the newest by default; that of version 0 is empty."""
        if version is None:
            version = (self.versions() or [0])[-1]
        if version == 0:
            return {"version": 0, "schema": None, "runs": [], "arrivals": []}
        stream = self._fs.open(self._path(self._manifest(version)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, change: Callable[[dict], dict | None], attempts: int = 20) -> dict:
        """The manifest that ``change`` makes of the newest one, or that one if it gives None."""
        for _ in range(attempts):
            old = self.manifest()
            new = change(json.loads(json.dumps(old)))
            if new is None:
                return old
            new["version"] = old["version"] + 1
            final, draft = self._path(self._manifest(new["version"])), self._path(f"{self.root}/drafts/{uuid.uuid4().hex}")
            self._fs.mkdirs(final.getParent())
            stream = self._fs.create(draft, False)
            stream.write(json.dumps(new).encode())
            stream.close()
            try:
                none = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                options = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = none
                self._files.rename(draft, final, options)
                return new
            except Exception as e:
                self._fs.delete(draft, False)
                if not self._fs.exists(final):
                    raise e
        raise RuntimeError(f"no version could be committed in {attempts} attempts")

    def _run(self, path: str) -> dict:
        """What a manifest says of the run in a folder."""
        files = []
        if self._fs.exists(self._path(path)):
            files = [s for s in self._fs.listStatus(self._path(path)) if s.isFile() and s.getPath().getName().endswith(".parquet")]
        return {"path": path, "files": len(files), "bytes": sum(s.getLen() for s in files)}

    # -- changes -----------------------------------------------------------

    def append(self, rows: DataFrame, arrival: Column | str) -> dict:
        """Append ``rows``: each value of ``arrival`` (a column, or one name for all) is an arrival and becomes a run."""
        arrival = F.lit(arrival) if isinstance(arrival, str) else arrival
        column = ARRIVAL
        while column in rows.columns:
            column += "_"
        batch = f"{self.root}/runs/{uuid.uuid4().hex}"
        rows.withColumn(column, arrival.cast("string")).write.partitionBy(column).parquet(batch)
        folders = [s.getPath() for s in self._fs.listStatus(self._path(batch)) if s.isDirectory() and s.getPath().getName().startswith(f"{column}=")]
        found = {f.getName().partition("=")[2]: self._run(f.toString()) for f in folders}
        if NAMELESS in found:
            self._fs.delete(self._path(batch), True)
            raise ValueError("an arrival's name is null or empty")

        def change(manifest: dict) -> dict | None:
            schema = json.loads(rows.schema.json())
            if manifest["schema"] is None:
                manifest["schema"] = schema
            elif [(f["name"], f["type"]) for f in manifest["schema"]["fields"]] != [(f["name"], f["type"]) for f in schema["fields"]]:
                raise ValueError("the arrival's columns are not those of the store")
            new = [a for a in sorted(found) if a not in manifest["arrivals"]]
            if not new and manifest["version"]:
                return None
            manifest["runs"] += [found[a] for a in new]
            manifest["arrivals"] += new
            return manifest

        return self._commit(change)

    def tiers(self, manifest: dict) -> dict[int, list[dict]]:
        """Runs by tier: each tier's are up to ``fanout`` times as large as those of the one below."""
        out: dict[int, list[dict]] = {}
        for run in manifest["runs"]:
            out.setdefault(int(math.log(max(run["bytes"], 1), self.fanout)), []).append(run)
        return out

    def _read(self, manifest: dict, runs: list[dict]) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        paths = [r["path"] for r in runs if r["files"]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def compact(self) -> dict:
        """Merge tiers that have ``fanout`` runs, lowest first, until none has."""
        while True:
            manifest = self.manifest()
            full = [runs for _, runs in sorted(self.tiers(manifest).items()) if len(runs) >= self.fanout]
            if not full:
                return manifest
            runs = full[0]
            path = f"{self.root}/runs/{uuid.uuid4().hex}"
            files = max(1, math.ceil(sum(r["bytes"] for r in runs) / self.target_bytes))
            # Files are dealt out as they are read: no shuffle, and a task writes one target-sized file.
            self._read(manifest, runs).coalesce(files).write.parquet(path)
            merged, gone = self._run(path), {r["path"] for r in runs}

            def change(now: dict) -> dict | None:
                if not gone <= {r["path"] for r in now["runs"]}:
                    return None  # another compaction took one of them: this run stays unnamed
                now["runs"] = [r for r in now["runs"] if r["path"] not in gone] + [merged]
                return now

            self._commit(change)

    def vacuum(self, keep_versions: int = 1, orphan_hours: float = ORPHAN_HOURS) -> int:
        """Delete all but the newest manifests and the runs that only those name; how many runs went.

        Folders of runs and drafts of manifests that nothing names and nobody has
        changed for ``orphan_hours`` go as well: their jobs have died.
        """
        versions = self.versions()
        old, kept = versions[:-keep_versions], versions[-keep_versions:]
        live = {r["path"] for v in kept for r in self.manifest(v)["runs"]}
        gone = {r["path"] for v in old for r in self.manifest(v)["runs"]} - live
        for v in old:
            self._fs.delete(self._path(self._manifest(v)), False)
        for path in gone:
            self._fs.delete(self._path(path), True)
        named = {p.rpartition("/runs/")[2].partition("/")[0] for p in live}
        before = (time.time() - orphan_hours * 3600) * 1000
        for folder in ("runs", "drafts"):
            if self._fs.exists(self._path(f"{self.root}/{folder}")):
                for s in self._fs.listStatus(self._path(f"{self.root}/{folder}")):
                    if s.getPath().getName() not in named and self._newest(s) <= before:
                        self._fs.delete(s.getPath(), True)
        return len(gone)

    def _newest(self, status) -> int:
        """When anything in a file or folder last changed."""
        below = self._fs.listStatus(status.getPath()) if status.isDirectory() else []
        return max([status.getModificationTime(), *map(self._newest, below)])

    # -- reading -----------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the newest by default."""
        manifest = self.manifest(version)
        if manifest["schema"] is None:
            raise ValueError("nothing was ever appended")
        return self._read(manifest, manifest["runs"])
