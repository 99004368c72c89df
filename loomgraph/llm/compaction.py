"""Sharding by size-tiered compaction, with DataFrame operations only.

Arrivals are appended as small immutable Parquet shards. A shard belongs to
the tier of its size (powers of ``FANOUT`` times ``LEAST_BYTES``). When a tier
below the target size holds ``FANOUT`` shards or more, they are merged into
files of about the target size. Each append and each merge commits a new
version of the manifest: the shards that come and go, and every ``SNAPSHOT``
versions the whole list, written beside and moved to its final name in one step
that fails if another writer has committed that version. Then an append takes
its turn after the newest version; a merge does so too if its shards are all
still there, and else removes what it wrote. Readers take the shards of one
version; files that no kept version names are removed by ``vacuum`` once they
are older than its grace period, as another writer may be about to commit them.

The driver handles the manifest only (a line a shard that comes or goes); rows
go from Parquet to Parquet without a shuffle. A lost executor costs its tasks,
and a failed write leaves files that no manifest names.

Defined cases: rows are kept whole and unchanged, repeats, nulls and extra
columns included; an empty arrival commits a version with no new shard; reading
a store without shards gives an empty table of the first arrival's schema.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET_BYTES = 64 << 20
LEAST_BYTES = 1 << 20
FANOUT = 4
#: Versions from one whole list of shards to the next, and seconds for which a file without a version is left alone.
SNAPSHOT, GRACE = 10, 86_400.0


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int


class CommitConflict(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, least: int = LEAST_BYTES, fanout: int = FANOUT):
        if fanout < 2 or least < 1 or target < least:
            raise ValueError("fanout must be 2 or more, and target at least the least size")
        self.spark, self.root, self.target, self.least, self.fanout = spark, root.rstrip("/"), target, least, fanout
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    # manifest

    def version(self) -> int:
        """The newest committed version, 0 before the first."""
        found = [0]
        for s in self._fs.listStatus(self._path(f"{self.root}/manifest")):
            name = s.getPath().getName()
            if name.startswith("v") and name.endswith(".json"):
                found.append(int(name[1:-5]))
        return max(found)

    def _load(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/manifest/v{version:09d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def manifest(self, version: int | None = None) -> dict:
        """Version, schema and live shards; base is the version whose whole list it starts from."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": [], "base": 1}
        steps = [self._load(version)]
        while "shards" not in steps[-1]:
            steps.append(self._load(steps[-1]["version"] - 1))
        live = {s["path"]: s for s in steps[-1]["shards"]}
        for step in reversed(steps[:-1]):
            for path in step["gone"]:
                live.pop(path)
            live |= {s["path"]: s for s in step["new"]}
        return {"version": version, "schema": steps[0]["schema"], "shards": list(live.values()), "base": steps[-1]["version"]}

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**s) for s in self.manifest(version)["shards"]]

    def _commit(self, new: list[Shard], gone: list[Shard], schema: str, after: int) -> int:
        """The version after another, with new shards and without those that are gone."""
        version = after + 1
        out = {"version": version, "schema": schema}
        if version % SNAPSHOT == 1:
            left = {s.path for s in gone}
            out["shards"] = [asdict(s) for s in self.shards(after) if s.path not in left] + [asdict(s) for s in new]
        else:
            out |= {"new": [asdict(s) for s in new], "gone": [s.path for s in gone]}
        temporary = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(temporary, False)
        stream.write(bytearray(json.dumps(out).encode()))
        stream.close()
        final = self._path(f"{self.root}/manifest/v{version:09d}.json")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(temporary, final, options)
        except Exception as e:  # py4j wraps the file system's own error
            self._fs.delete(temporary, False)
            if self._fs.exists(final):
                raise CommitConflict(f"version {version} is taken") from e
            raise
        return version

    def _commit_new(self, new: list[Shard], schema: str) -> int:
        """New shards after the newest version, whoever committed it."""
        while True:
            try:
                return self._commit(new, [], schema, self.version())
            except CommitConflict:
                continue

    def _commit_merge(self, new: list[Shard], gone: list[Shard], schema: str) -> int | None:
        """A merge after the newest version, or None if another writer has taken some of its shards."""
        while True:
            version = self.version()
            if not {s.path for s in gone} <= {s.path for s in self.shards(version)}:
                return None
            try:
                return self._commit(new, gone, schema, version)
            except CommitConflict:
                continue

    def _written(self, folder: str) -> list[Shard]:
        out = []
        files = self._fs.listFiles(self._path(folder), True)
        while files.hasNext():
            s = files.next()
            if s.getPath().getName().startswith("part-"):
                out.append(Shard(s.getPath().toString(), s.getLen()))
        return sorted(out, key=lambda s: s.path)

    # writing

    def append(self, rows: DataFrame) -> int:
        """One arrival: its partitions become shards as they are."""
        return self.append_all(rows, None)

    def append_all(self, rows: DataFrame, arrival: str | None) -> int:
        """Arrivals by the values of a column that is not kept: one write, one version an arrival."""
        schema = T.StructType([f for f in rows.schema if f.name != arrival])
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        writer = rows.write
        (writer.partitionBy(arrival) if arrival else writer).parquet(folder)
        groups: dict[str, list[Shard]] = {}
        for s in self._written(folder):
            groups.setdefault(s.path.rsplit("/", 1)[0], []).append(s)
        version = self.version()
        for _, own in sorted(groups.items()) or [("", [])]:
            self._commit_new(own, schema.json())
            version = self.compact()
        return version

    def tier(self, size: int) -> int:
        return max(0, int(math.log(max(size, 1) / self.least, self.fanout)) + 1) if size > self.least else 0

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs to merge: the shards of each tier below the target that has enough of them."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target / 2:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        return [own for _, own in sorted(tiers.items()) if len(own) >= self.fanout]

    def compact(self) -> int:
        """Merges until no tier is full; each merge is a version."""
        while True:
            manifest = self.manifest()
            runs = self.plan([Shard(**s) for s in manifest["shards"]])
            if not runs:
                return manifest["version"]
            files = max(1, math.ceil(sum(s.bytes for s in runs[0]) / self.target))
            folder = f"{self.root}/shards/{uuid.uuid4().hex}"
            self._open(manifest["schema"], runs[0]).coalesce(files).write.parquet(folder)
            if self._commit_merge(self._written(folder), runs[0], manifest["schema"]) is None:
                self._fs.delete(self._path(folder), True)

    # reading

    def _open(self, schema: str, shards: list[Shard]) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[s.path for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        manifest = self.manifest(version)
        if manifest["schema"] is None:
            raise ValueError("nothing has arrived yet")
        return self._open(manifest["schema"], [Shard(**s) for s in manifest["shards"]])

    def vacuum(self, keep: int = 1, grace: float = GRACE) -> int:
        """Removes the files that none of the newest keep versions names and that are older than grace seconds; returns how many."""
        newest = self.version()
        kept = [self.manifest(v) for v in range(max(1, newest - keep + 1), newest + 1)]
        live = {s["path"] for m in kept for s in m["shards"]}
        before, removed = (time.time() - grace) * 1000, 0
        files = self._fs.listFiles(self._path(f"{self.root}/shards"), True)
        while files.hasNext():
            s = files.next()
            if s.getPath().getName().startswith("part-") and s.getPath().toString() not in live and s.getModificationTime() <= before:
                removed += bool(self._fs.delete(s.getPath(), False))
        for v in range(1, min((m["base"] for m in kept), default=1)):
            self._fs.delete(self._path(f"{self.root}/manifest/v{v:09d}.json"), False)
        return removed


def compacted(docs: DataFrame, root: str, arrivals: int = 4, id_col: str = "doc_id", **sizes) -> DataFrame:
    """All rows of docs after they have arrived in turns and been compacted, read from the newest version."""
    store = ShardStore(docs.sparkSession, root, **sizes)
    turn = "arrival_turn"
    while turn in docs.columns:
        turn += "_"
    store.append_all(docs.withColumn(turn, F.coalesce(F.pmod(F.col(id_col), F.lit(arrivals)), F.lit(0)).cast("int")), turn)
    store.vacuum(grace=0)  # this store has no other writer
    return store.read()
