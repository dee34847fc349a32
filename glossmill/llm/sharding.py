"""Size-tiered compaction of immutable shards under a versioned manifest.

A store is a folder of parquet shards, lists of shards and manifests.  An arrival
is appended as small shards that never change again.  Compaction takes the shards
of one size tier (sizes within a factor ``ratio``) and merges them into files of
about the target size: one scan per tier, dealt into as many tasks as the tier has
times the target, each of which writes one file.  However many merges a tier has
they are one job, no plan names them one by one and no row is shuffled.

A manifest version names lists; a list names at most ``list_shards`` shards and
never changes either, so a commit writes the lists it touches and no others.  The
commit itself is an atomic rename that fails if another writer took the version,
so readers always see a whole version and a failed job leaves only files that no
manifest names.  Like any scan of files, reading and compacting give the planner
the paths of all shards they read.

Defined cases: columns of any name are kept as they are, nulls and repeated rows
too; an empty table makes an empty version; shards of half the target or more
are left alone; a tier of fewer than ``fan_in`` shards, or of fewer than twice the
files that would come of it, waits for more arrivals.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.common import table, text_or_empty, work_path

TARGET_BYTES = 32 << 20
ARRIVAL_ROWS = 1000


@dataclass(frozen=True)
class Shard:
    """One immutable file of a store."""

    path: str
    bytes: int
    sequence: int
    merged: bool = False
    listed: str = ""


class CommitConflict(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    """Append, compact and read the shards below a path."""

    SHARD = "path string, bytes long, sequence long, merged boolean"

    def __init__(
        self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, ratio: float = 4.0, fan_in: int = 4, list_shards: int = 10_000
    ):
        self.spark, self.path = spark, path.rstrip("/")
        self.target_bytes, self.ratio, self.fan_in, self.list_shards = target_bytes, ratio, fan_in, list_shards
        self._jvm = spark._jvm
        self._fs_path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _list(self, path: str, suffix: str) -> list[tuple[str, int]]:
        where = self._fs_path(path)
        if not self._fs.exists(where):
            return []
        found = [(str(s.getPath().toString()), int(s.getLen())) for s in self._fs.listStatus(where)]
        return sorted(x for x in found if x[0].endswith(suffix))

    def versions(self) -> list[int]:
        """All committed versions, in order."""
        return [int(p.rpartition("/v")[2][:-5]) for p, _ in self._list(f"{self.path}/manifest", ".json")]

    def version(self, number: int | None = None) -> dict:
        """The named or the latest version: its number, schema, next sequence and lists of shards."""
        have = self.versions()
        if not have:
            return {"version": 0, "schema": None, "next": 0, "lists": []}
        name = f"{self.path}/manifest/v{number or have[-1]:08d}.json"
        return json.loads(self.spark.read.text(name, wholetext=True).first()[0])

    def shards(self, version: dict) -> list[Shard]:
        """The shards of a version, in order of arrival."""
        if not version["lists"]:
            return []
        rows = self.spark.read.schema(self.SHARD).json([f"{self.path}/lists/{n}" for n in version["lists"]])
        found = rows.select("*", F.element_at(F.split("_metadata.file_name", "/"), -1).alias("listed"))
        return sorted((Shard(*r) for r in found.collect()), key=lambda s: s.sequence)

    def manifest(self, version: int | None = None) -> dict:
        """The named or the latest version, with its shards."""
        known = self.version(version)
        return known | {"shards": self.shards(known)}

    def _put(self, path: str, text: str) -> None:
        stream = self._fs.create(self._fs_path(path), False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def _commit(self, before: dict, schema: str, gone: list[Shard], new: list[tuple[str, int]], merged: bool = False) -> int:
        """A version like ``before`` without the shards ``gone`` and with files as ``new`` ones; returns its number."""
        touched = {s.listed for s in gone}
        paths = {s.path for s in gone}
        rest = [s for s in self.shards({"lists": sorted(touched)}) if s.path not in paths]
        fresh = [Shard(p, n, before["next"] + i, merged) for i, (p, n) in enumerate(new)]
        lists = [n for n in before["lists"] if n not in touched]
        every = rest + fresh
        for at in range(0, len(every), self.list_shards):
            name = f"l-{uuid.uuid4().hex}.json"
            rows = [{k: v for k, v in asdict(s).items() if k != "listed"} for s in every[at : at + self.list_shards]]
            self._put(f"{self.path}/lists/{name}", "".join(json.dumps(r) + "\n" for r in rows))
            lists.append(name)
        version = before["version"] + 1
        folder = f"{self.path}/manifest"
        self._fs.mkdirs(self._fs_path(folder))
        draft = f"{folder}/.{uuid.uuid4().hex}.tmp"
        self._put(draft, json.dumps({"version": version, "schema": schema, "next": before["next"] + len(fresh), "lists": lists}))
        fs = self._jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        how[0] = fs.Options.Rename.NONE
        try:
            context.rename(self._fs_path(draft), self._fs_path(f"{folder}/v{version:08d}.json"), how)
        except Exception as error:
            self._fs.delete(self._fs_path(draft), False)
            raise CommitConflict(f"version {version} of {self.path} is taken") from error
        return version

    def _write(self, df: DataFrame, rows: int | None = None) -> list[tuple[str, int]]:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        (writer.option("maxRecordsPerFile", rows) if rows else writer).parquet(folder)
        return self._list(folder, ".parquet")

    def append(self, df: DataFrame, rows_per_shard: int = ARRIVAL_ROWS) -> int:
        """Write an arrival as small shards and commit it; returns the version."""
        before = self.version()
        return self._commit(before, before["schema"] or df.schema.json(), [], self._write(df, rows_per_shard))

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """The shards to merge, by tier."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target_bytes // 2:
                tiers.setdefault(int(math.log(max(s.bytes, 1), self.ratio)), []).append(s)
        ready = (t for _, t in sorted(tiers.items()))
        # At most half as many files come out as go in, so compaction ends.
        return [t for t in ready if len(t) >= max(self.fan_in, 2 * -(-sum(s.bytes for s in t) // self.target_bytes))]

    def compact(self) -> int:
        """Merge until no tier has enough shards left; returns the latest version."""
        while True:
            before = self.manifest()
            tiers = self.plan(before["shards"])
            if not tiers:
                return before["version"]
            schema = self._schema(before)
            new = [f for tier in tiers for f in self._merge(tier, schema)]
            self._commit(before, before["schema"], [s for t in tiers for s in t], new, merged=True)

    def _merge(self, tier: list[Shard], schema) -> list[tuple[str, int]]:
        """Files of about the target size with the rows of a tier, each by a task of one scan.

        The scan packs shards into pieces of an eighth of the target, and as many
        neighbouring pieces as make the target are one task.  The settings for that
        are the session's own again afterwards; where they cannot be changed the
        pieces have another size and the files are as many.
        """
        packed = {"maxPartitionBytes": max(self.target_bytes // 8, 1), "openCostInBytes": 0, "minPartitionNum": 1}
        names = {f"spark.sql.files.{k}": str(v) for k, v in packed.items()}
        before = {n: self.spark.conf.get(n, None) for n in names}
        for n, v in names.items():
            self.spark.conf.set(n, v)
        try:
            files = -(-sum(s.bytes for s in tier) // self.target_bytes)
            return self._write(self.spark.read.schema(schema).parquet(*[s.path for s in tier]).coalesce(files))
        finally:
            for n, v in before.items():
                self.spark.conf.set(n, v) if v is not None else self.spark.conf.unset(n)

    def _schema(self, manifest: dict):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(manifest["schema"]))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with ``_metadata`` of their shards."""
        manifest = self.manifest(version)
        if not manifest["schema"]:
            raise ValueError(f"{self.path} has no version")
        paths = [s.path for s in manifest["shards"]]
        if not paths:
            return self.spark.createDataFrame([], self._schema(manifest))
        return self.spark.read.schema(self._schema(manifest)).parquet(*paths)


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """Append ``documents`` as small shards, compact them, and read the committed version back.

    Returns per document: doc_id, n_bytes and crc32 of its text, and the shard that holds it.
    """
    store = ShardStore(spark, work_path(spark, "shards"))
    store.append(table(spark, sf_dir, "documents"))
    store.compact()
    text = text_or_empty()
    return store.read().select(
        "doc_id",
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.col("_metadata.file_name").alias("shard"),
    )
