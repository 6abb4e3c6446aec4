"""Sharding (operator 2): size-tiered compaction under a versioned manifest.

A store is a folder of immutable Parquet shards and of manifests, one per version; the latest
names the live shards, by way of immutable segments: lists of shards that versions share, so that
a commit writes down what it changes and not all there is. Arrivals are appended as small shards.
``compact`` sorts shards into tiers by size (powers of ``fan_in``); where a tier has ``fan_in``
runs or more, runs of it are merged, up to the target size: one task streams the runs of a group
into one file, and a job does up to ``GROUPS_PER_JOB`` groups without a shuffle. Each round commits
one manifest, written beside and renamed into place, so that readers see the old set or the new one.
A writer that lost a race reads the new version and tries again; a merge whose shards went
meanwhile is dropped and planned anew.

Readers of older versions keep their files: ``vacuum`` removes manifests that are neither among the
last ones nor younger than ``retain_s``, and data or segment files that no manifest left names, if
they are older than ``retain_s`` too, as a younger one may belong to a commit under way. So what a
crashed or beaten writer left goes as well. Lost executors only repeat a merge.

Defined results: nulls, empty texts, repeated rows and any columns are stored as they are; an
empty arrival adds no shard; an empty store reads as an empty frame of its schema.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._common import hadoop_path, scratch

TARGET_BYTES = 64 << 20
FAN_IN = 4
#: Rows of an arrival's shard at most.
ARRIVAL_ROWS = 2000
#: Groups that one job merges, and jobs at a time.
GROUPS_PER_JOB, JOBS_AT_ONCE = 64, 4
#: Segments of a manifest at most before small ones are joined, and shards of one.
SEGMENTS, SEGMENT_SHARDS = 32, 20_000
#: Commits a writer tries before it gives up.
TRIES = 20
#: Seconds that files no version needs, and versions that aren't the latest, are kept for readers.
RETAIN_S = 24 * 3600
#: Arrivals that ``compacted`` deals a frame out to.
ARRIVALS = 4


class ConflictError(RuntimeError):
    """Another writer has committed this version."""


def tier(size: int, fan_in: int = FAN_IN) -> int:
    """Sizes within a factor of ``fan_in`` share a tier."""
    t, size = 0, size >> 16
    while size >= fan_in:
        t, size = t + 1, size // fan_in
    return t


def plan_merges(shards: list[dict], target: int = TARGET_BYTES, fan_in: int = FAN_IN) -> list[list[dict]]:
    """Runs of one tier to be merged, in groups of at most the target size."""
    tiers: dict[int, list[dict]] = {}
    for s in shards:
        if 2 * s["bytes"] <= target:
            tiers.setdefault(tier(s["bytes"], fan_in), []).append(s)
    groups = []
    for _, runs in sorted(tiers.items()):
        if len(runs) < fan_in:
            continue
        group: list[dict] = []
        for s in sorted(runs, key=lambda s: (s["bytes"], s["path"])):
            if group and sum(x["bytes"] for x in group) + s["bytes"] > target:
                groups.append(group)
                group = []
            group.append(s)
        groups.append(group)
    return [g for g in groups if len(g) > 1]


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, *, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.path, self.target, self.fan_in = spark, path.rstrip("/"), target_bytes, fan_in

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/manifests/v{version:010d}.json"

    def _list(self, folder: str) -> list:
        """(name, path, is a folder, milliseconds) of what a folder of the store holds."""
        fs, p = hadoop_path(self.spark, f"{self.path}/{folder}")
        return [(s.getPath().getName(), s.getPath().toString(), s.isDirectory(), s.getModificationTime()) for s in fs.listStatus(p)] if fs.exists(p) else []

    def _load(self, path: str):
        fs, p = hadoop_path(self.spark, path)
        stream = fs.open(p)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _save(self, path: str, value):
        fs, p = hadoop_path(self.spark, path)
        out = fs.create(p, False)
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()
        return fs, p

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n, *_ in self._list("manifests") if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """version, schema, segments (the files) and shards (all of them, each with its segment)."""
        have = self.versions()
        if not have:
            return {"version": 0, "schema": None, "segments": [], "shards": []}
        m = self._load(self._manifest_path(have[-1] if version is None else version))
        return m | {"shards": [s | {"segment": f} for f in m["segments"] for s in self._load(f"{self.path}/segments/{f}")]}

    def _commit(self, base: dict, gone: set[str], new: list[dict], schema: str) -> dict:
        """The next version of ``base`` without the shards ``gone`` and with ``new``, in one rename that fails if another writer was first."""
        by: dict[str, list[dict]] = {f: [] for f in base["segments"]}
        for s in base["shards"]:
            by[s["segment"]].append(s)
        # segments that lose a shard are written anew, and small ones join where there are many
        changed = {f for f, shards in by.items() if any(s["path"] in gone for s in shards)}
        if len(by) >= SEGMENTS:
            changed |= {f for f, shards in by.items() if len(shards) < SEGMENT_SHARDS // 2}
        bare = [{k: v for k, v in s.items() if k != "segment"} for s in [*(s for f in by if f in changed for s in by[f] if s["path"] not in gone), *new]]
        segments = [f for f in by if f not in changed]
        for at in range(0, len(bare), SEGMENT_SHARDS):
            segments.append(f"{uuid.uuid4().hex}.json")
            self._save(f"{self.path}/segments/{segments[-1]}", bare[at : at + SEGMENT_SHARDS])
        version = base["version"] + 1
        fs, temp = self._save(f"{self.path}/manifests/.{uuid.uuid4().hex}", {"version": version, "schema": schema, "segments": segments})
        sc = self.spark.sparkContext
        _, final = hadoop_path(self.spark, self._manifest_path(version))
        jvm = sc._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
        try:
            context.rename(temp, final, sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(temp, False)
            if "FileAlreadyExists" in str(e):
                raise ConflictError(f"version {version} is there already") from e
            raise
        return self.manifest(version)

    def _retry(self, change: Callable[[dict], tuple[set[str], list[dict], str] | None]) -> dict:
        """Commit a change of the latest version; ``change`` gives shards that go, new ones and the schema, or None."""
        for _ in range(TRIES):
            base = self.manifest()
            what = change(base)
            if what is None:
                return base
            try:
                return self._commit(base, *what)
            except ConflictError:
                time.sleep(0.05)
        raise ConflictError(f"other writers were first {TRIES} times")

    def _write(self, df: DataFrame, max_rows: int = 0) -> list[dict]:
        """A new folder of shards: path, bytes and rows of each."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", max_rows).parquet(folder)
        fs, p = hadoop_path(self.spark, folder)
        rows = self.spark.read.schema(df.schema).parquet(folder).groupBy(F.col("_metadata.file_name").alias("f")).count()
        counts = {r["f"]: r["count"] for r in rows.collect()}  # one row for each shard of this arrival
        found = [(s.getPath().getName(), s.getLen()) for s in fs.listStatus(p)]
        return [{"path": f"{folder}/{n}", "bytes": size, "rows": counts[n]} for n, size in found if counts.get(n)]

    def append(self, df: DataFrame, max_rows: int = ARRIVAL_ROWS) -> dict:
        new = self._write(df, max_rows)
        return self._retry(lambda base: (set(), new, df.schema.json()))

    def _read(self, paths: list[str], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if m["schema"] is None:
            raise ValueError("the store is empty")
        return self._read([s["path"] for s in m["shards"]], T.StructType.fromJson(json.loads(m["schema"])))

    def compact(self) -> dict:
        """Merge until no tier has enough runs."""
        while groups := plan_merges((base := self.manifest())["shards"], self.target, self.fan_in):
            schema = T.StructType.fromJson(json.loads(base["schema"]))

            def merge(some, schema=schema):
                """Groups to a file each: (shards that went in, shards that came out)."""
                out = self._write(reduce(DataFrame.unionAll, [self._read([s["path"] for s in g], schema).coalesce(1) for g in some]))
                gone = [s for g in some for s in g]
                if sum(s["rows"] for s in out) != sum(s["rows"] for s in gone):
                    raise RuntimeError("a merge lost rows; nothing was committed")
                return {s["path"] for s in gone}, out

            with ThreadPoolExecutor(JOBS_AT_ONCE) as pool:
                merged = list(pool.map(merge, [groups[i : i + GROUPS_PER_JOB] for i in range(0, len(groups), GROUPS_PER_JOB)]))

            def change(now, merged=merged):
                live = {s["path"] for s in now["shards"]}
                good = [(gone, out) for gone, out in merged if gone <= live]  # another compaction may have taken some
                return (set().union(*(g for g, _ in good)), [s for _, out in good for s in out], now["schema"]) if good else None

            self._retry(change)
        return self.manifest()

    def vacuum(self, keep_versions: int = 1, retain_s: float = RETAIN_S) -> None:
        """Delete old manifests, and old files that those left don't name."""
        limit = (time.time() - retain_s) * 1000
        have = self.versions()
        old = {f"v{v:010d}.json" for v in have[: max(0, len(have) - keep_versions)]}
        for name, path, _, at in self._list("manifests"):
            if at <= limit and (name in old or name.startswith(".")):
                self._delete(path)
        left = [self.manifest(v) for v in self.versions()]
        segments, shards = {f for m in left for f in m["segments"]}, {"/".join(s["path"].rsplit("/", 2)[1:]) for m in left for s in m["shards"]}
        for name, path, _, at in self._list("segments"):
            if at <= limit and name not in segments:
                self._delete(path)
        for folder, path, is_folder, at in self._list("data"):
            if not is_folder or at > limit:
                continue  # a folder's time is that of its last file
            files = [(n, p) for n, p, *_ in self._list(f"data/{folder}") if n.endswith(".parquet")]
            dead = [p for n, p in files if f"{folder}/{n}" not in shards]
            for p in [path] if len(dead) == len(files) else dead:
                self._delete(p)

    def _delete(self, path: str) -> None:
        fs, p = hadoop_path(self.spark, path)
        fs.delete(p, True)


def compacted(docs: DataFrame, arrivals: int = ARRIVALS) -> DataFrame:
    """``docs`` as several arrivals in a new store, compacted after each, and read back through its manifest."""
    store = ShardStore(docs.sparkSession, scratch(docs.sparkSession, "store"))
    dealt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]), F.lit(arrivals))
    for k in range(arrivals):
        store.append(docs.where(dealt == k))
        store.compact()
        store.vacuum(retain_s=0)  # the store is this function's own
    return store.read()
