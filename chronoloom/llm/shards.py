"""A store of immutable Parquet shards with size-tiered compaction and versioned manifests.

Layout: shards/<name>/ holds shards' files, manifests/<version>.json what a version adds to the one before it and takes away,
every FULL-th one names all its shards. A version is committed by renaming its finished manifest to a name that must not
exist yet, so readers see whole versions only, and of two writers one does its change again on top of the other's.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import if_small, unused

MEGABYTE = 1 << 20
#: Every so many versions a manifest names all shards.
FULL = 16
#: Seconds for which vacuum leaves files alone that no version names, as a writer may be about to commit them, and how many versions it keeps.
GRACE, KEEP = 24 * 3600, 8
#: How often a change is done again after another writer was faster.
RETRIES = 20


@dataclass(frozen=True)
class Shard:
    """A file of the store, by its path below the store's folder."""

    path: str
    rows: int
    size: int
    born: int


class CommitConflict(RuntimeError):
    """Another writer has committed the version meanwhile."""


class ShardStore:
    """Appends small shards and merges those of a tier into files of about the target size.

    target: bytes of a full shard; fan_in: how many shards of a tier make a merge worthwhile; a tier holds the
    sizes between two powers of fan_in below the target. groups_per_job: merges that run in one Spark
    job, a task each. Every merge reads at most target bytes or two shards, so none outgrows a task.
    """

    def __init__(self, spark: SparkSession, root: str, *, target: int = 128 * MEGABYTE, fan_in: int = 4, groups_per_job: int = 64):
        self.spark, self.root, self.target, self.fan_in, self.groups_per_job = spark, root.rstrip("/"), target, fan_in, groups_per_job
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path("").getFileSystem(self._conf)
        self._files.mkdirs(self._path("manifests"))

    def _path(self, below: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}" if below else self.root)

    def version(self) -> int:
        """The latest committed version, 0 for an empty store."""
        names = [s.getPath().getName() for s in self._files.listStatus(self._path("manifests"))]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_"))), default=0)

    def _manifest(self, version: int) -> dict:
        stream = self._files.open(self._path(f"manifests/{version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def shards(self, version: int | None = None) -> list[Shard]:
        """The shards of a version, by default the latest, in the order in which they came."""
        at = self.version() if version is None else version
        later: list[dict] = []
        while at and "shards" not in (manifest := self._manifest(at)):
            later.append(manifest)
            at -= 1
        found = {x["path"]: Shard(**x) for x in (manifest["shards"] if at else [])}
        for manifest in reversed(later):
            for path in manifest["removed"]:
                found.pop(path, None)
            found |= {x["path"]: Shard(**x) for x in manifest["added"]}
        return list(found.values())

    def _commit(self, version: int, added: list[Shard], removed: list[str]) -> int:
        content = {"version": version, "added": [asdict(s) for s in added], "removed": removed}
        if version % FULL == 0:
            gone = set(removed)
            content = {"version": version, "shards": [asdict(s) for s in (*(s for s in self.shards(version - 1) if s.path not in gone), *added)]}
        draft = self._path(f"manifests/.{uuid.uuid4().hex}")
        out = self._files.create(draft)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, self._path(f"manifests/{version:012d}.json"), none)
        except Exception as e:
            self._files.delete(draft, False)
            if self._files.exists(self._path(f"manifests/{version:012d}.json")):
                raise CommitConflict(f"version {version} is there already") from e
            raise
        return version

    def _change(self, change: Callable[[], tuple[list[Shard], list[str]] | None]) -> int:
        """Commit what change() gives as the next version; again if another writer was faster. None changes nothing."""
        for _ in range(RETRIES):
            version = self.version() + 1
            what = change()
            if what is None:
                return version - 1
            try:
                return self._commit(version, [replace(s, born=version) for s in what[0]], what[1])
            except CommitConflict:
                continue
        raise CommitConflict(f"{RETRIES} other writers were faster")

    def _write(self, df: DataFrame, by: str | None = None) -> list[Shard]:
        """One shard per partition of df that has rows, or per value of `by` in it; that column isn't stored."""
        folder = f"shards/{uuid.uuid4().hex}"
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(f"{self.root}/{folder}")
        sizes, files = {}, self._files.listFiles(self._path(folder), True)
        while files.hasNext():
            file = files.next()
            if file.getPath().getName().endswith(".parquet"):
                sizes[folder + file.getPath().toString().split(folder, 1)[1]] = file.getLen()
        if not sizes:
            return []
        written = self.spark.read.parquet(f"{self.root}/{folder}")
        rows = {folder + r[0].split(folder, 1)[1]: r[1] for r in written.groupBy(F.col("_metadata.file_path")).count().collect()}
        return [Shard(path, rows[path], size, 0) for path, size in sorted(sizes.items()) if rows.get(path)]

    def append(self, df: DataFrame) -> int:
        """Commit df's partitions as new small shards; the version.

        All columns are stored as they are, whatever their names, nulls and repeated rows too. df may lack columns of other
        arrivals or have others. An empty df commits a version without new shards. If another writer commits
        meanwhile, the shards are committed on top of its version.
        """
        new = self._write(df)
        return self._change(lambda: (new, []))

    def tier(self, shard: Shard) -> int:
        """0 for a shard of at least half the target; each further tier is fan_in times smaller."""
        return 0 if 2 * shard.size >= self.target else 1 + int(math.log(self.target / (2 * shard.size), self.fan_in) + 1e-9)

    def plan(self) -> list[list[Shard]]:
        """Groups of shards to merge: of each tier below the full one with fan_in shards or more, in order of age."""
        tiers: dict[int, list[Shard]] = {}
        for shard in self.shards():
            tiers.setdefault(self.tier(shard), []).append(shard)
        groups = []
        for tier in sorted(set(tiers) - {0}):
            if len(tiers[tier]) < self.fan_in:
                continue
            group: list[Shard] = []
            for shard in sorted(tiers[tier], key=lambda s: (s.born, s.path)):
                if len(group) > 1 and sum(s.size for s in group) + shard.size > self.target:
                    groups.append(group)
                    group = []
                group.append(shard)
            if len(group) > 1:
                groups.append(group)
        return groups

    def compact(self) -> int:
        """Merge tiers until none has enough shards; the last version. A round commits its merges at once.

        A merged shard has the columns of all its round's shards, null where a shard lacks one, so shards of
        different columns merge; columns of one name but different types raise an error and nothing is
        committed. No row is dropped or joined with another. If other writers commit meanwhile, the merge is
        committed on top of theirs, unless they merged the same shards.
        """
        while groups := self.plan():
            for i in range(0, len(groups), self.groups_per_job):
                part = groups[i : i + self.groups_per_job]
                merged, schema = None, self.read([s for group in part for s in group]).schema
                for group in part:
                    one = self.spark.read.schema(schema).parquet(*self._paths(group)).coalesce(1)
                    merged = one if merged is None else merged.union(one)
                new, gone = self._write(merged), [s.path for group in part for s in group]

                def change(new: list[Shard] = new, gone: list[str] = gone) -> tuple[list[Shard], list[str]] | None:
                    return (new, gone) if set(gone) <= {s.path for s in self.shards()} else None

                self._change(change)
        return self.version()

    def read(self, shards: list[Shard] | None = None) -> DataFrame:
        """The rows of the given shards, by default those of the latest version, with the columns of all of them."""
        return self.spark.read.option("mergeSchema", "true").parquet(*self._paths(self.shards() if shards is None else shards))

    def _paths(self, shards: list[Shard]) -> list[str]:
        return [f"{self.root}/{s.path}" for s in shards]

    def vacuum(self, *, older_than: float = GRACE, keep: int = KEEP) -> int:
        """Delete shards that none of the last `keep` versions names and that are older than `older_than` seconds; how many went.

        The age protects the shards of writers that haven't committed yet, the versions kept protect readers. Manifests that no kept
        version needs go too.
        """
        version = self.version()
        first = max(1, version - keep + 1)
        live = {s.path for v in range(first, version + 1) for s in self.shards(v)}
        limit, gone = (time.time() - older_than) * 1000, 0
        if not self._files.exists(self._path("shards")):
            return 0
        for folder in self._files.listStatus(self._path("shards")):
            files, left = self._files.listFiles(folder.getPath(), True), False
            while files.hasNext():
                file = files.next()
                name = file.getPath().toString()
                path = "shards" + name[name.index(f"/{folder.getPath().getName()}/") :]
                if path in live or file.getModificationTime() > limit:
                    left = True
                elif path.endswith(".parquet"):
                    gone += bool(self._files.delete(file.getPath(), False))
            if not left:
                self._files.delete(folder.getPath(), True)
        needed = first
        while needed > 1 and "shards" not in self._manifest(needed):
            needed -= 1
        for status in self._files.listStatus(self._path("manifests")):
            name = status.getPath().getName()
            if name.endswith(".json") and not name.startswith(".") and int(name.removesuffix(".json")) < needed:
                self._files.delete(status.getPath(), False)
        return gone


def load_in_waves(spark: SparkSession, root: str, docs: DataFrame, *, waves: int = 4, key: str = "doc_id", target: int = 128 * MEGABYTE, fan_in: int = 4) -> ShardStore:
    """A store that got docs as `waves` arrivals (by hash of the key; null is one), compacted after each and cleaned at the end.

    One pass over docs writes the shards of all arrivals; they are then committed one arrival after the other. All rows and columns
    are stored as they are. An arrival may be empty, as may docs.
    """
    store = ShardStore(spark, root, target=target, fan_in=fan_in)
    [arrival] = unused(docs, "arrival")
    shards = store._write(docs.withColumn(arrival, F.pmod(F.xxhash64(key), F.lit(waves))), by=arrival)
    for wave in range(waves):
        new = [s for s in shards if f"/{arrival}={wave}/" in s.path]
        store._change(lambda new=new: (new, []))
        store.compact()
    store.vacuum(older_than=0, keep=1)  # no other writer knows the new store
    return store


def shard_rows(store: ShardStore, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per stored row: key, shard, shard_tier, version, text_sha256 (of the text, null as empty). An empty store has no rows."""
    shards = store.shards()
    kinds = f"{key} long, shard string, shard_tier int, version long, text_sha256 string"
    if not shards:
        return store.spark.createDataFrame([], kinds)
    rows = store.read(shards).select(F.col(key).alias(key), F.element_at(F.split(F.col("_metadata.file_path"), "/shards/"), -1).alias("_file"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text_sha256"))
    about = [(x.path.removeprefix("shards/"), f"shard-{i:06d}", store.tier(x), x.born) for i, x in enumerate(shards)]
    named = if_small(store.spark.createDataFrame(about, "_file string, shard string, shard_tier int, version long"))
    return rows.join(named, "_file").select(key, "shard", "shard_tier", "version", "text_sha256")
