"""Size-tiered compaction of Parquet shards under versioned manifests.

An arrival is written as small shards that never change. Compaction merges shards of similar size, a tier, into files of about the target
size. What a version holds is listed in its manifest; a manifest appears under its number by one rename that fails if the number is
taken, so readers see the version before or the one after, never a mixture, and of two writers one starts again from what the other made.

A manifest names parts: files that never change, each with a list of shards. An arrival adds one part and takes over the others by name, so
that it writes no more than its own shards' names; compaction writes one part for all. The manifest also holds the table's schema, to
which arrivals may add columns; rows of earlier arrivals have nulls there.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import hadoop_fs


class VersionTaken(Exception):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Shard:
    path: str
    size: int


@dataclass(frozen=True)
class Part:
    """A list of shards in a file of its own; ``arrivals``: those whose rows they hold."""

    path: str
    arrivals: tuple[str, ...]


@dataclass(frozen=True)
class Manifest:
    version: int
    parts: tuple[Part, ...]
    #: The table's schema as JSON; empty in version 0.
    schema: str = ""

    @property
    def arrivals(self) -> tuple[str, ...]:
        return tuple(a for p in self.parts for a in p.arrivals)


@dataclass(frozen=True)
class Tiers:
    """Shards of ``smallest`` bytes or less are tier 0; each tier is ``ratio`` times larger. Those of half the ``target`` or more are full."""

    target: int = 64 << 20
    smallest: int = 1 << 20
    ratio: float = 4.0
    fewest: int = 2

    def of(self, size: int) -> int:
        return 0 if size <= self.smallest else 1 + int(math.log(size / self.smallest, self.ratio))

    def merges(self, shards: tuple[Shard, ...]) -> list[list[Shard]]:
        """Runs of shards of one tier that aren't full, ``fewest`` at least, smaller tiers first."""
        by: dict[int, list[Shard]] = {}
        for s in shards:
            if 2 * s.size < self.target:
                by.setdefault(self.of(s.size), []).append(s)
        return [run for _, run in sorted(by.items()) if len(run) >= self.fewest]


class ShardStore:
    """A folder with ``data`` and ``manifests``, in any file system that all executors reach."""

    def __init__(self, spark: SparkSession, root: str, tiers: Tiers = Tiers()):
        self.spark, self.root, self.tiers = spark, root.rstrip("/"), tiers
        for folder in ("manifests", "parts", "data"):
            fs, p = hadoop_fs(spark, f"{self.root}/{folder}")
            fs.mkdirs(p)

    def _name(self, version: int) -> str:
        return f"{self.root}/manifests/v{version:010d}.json"

    def version(self) -> int:
        """The latest version; 0: none."""
        fs, p = hadoop_fs(self.spark, f"{self.root}/manifests")
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return max([int(n[1:11]) for n in names if n.startswith("v")], default=0)

    def manifest(self, version: int | None = None) -> Manifest:
        version = self.version() if version is None else version
        if version == 0:
            return Manifest(0, ())
        found = json.loads(self._text(self._name(version)))
        return Manifest(found["version"], tuple(Part(p["path"], tuple(p["arrivals"])) for p in found["parts"]), found["schema"])

    def shards(self, m: Manifest) -> tuple[Shard, ...]:
        return tuple(Shard(**x) for p in m.parts for x in map(json.loads, self._text(f"{self.root}/{p.path}").splitlines()))

    def _text(self, path: str) -> str:
        fs, p = hadoop_fs(self.spark, path)
        stream = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> None:
        fs, p = hadoop_fs(self.spark, path)
        out = fs.create(p, False)
        out.write(bytearray(text.encode()))
        out.close()

    def _commit(self, new: Manifest) -> Manifest:
        jvm = self.spark._jvm
        draft_name = f"{self.root}/manifests/draft-{uuid.uuid4().hex}"
        fs, draft = hadoop_fs(self.spark, draft_name)
        _, final = hadoop_fs(self.spark, self._name(new.version))
        self._put(draft_name, json.dumps(asdict(new)))
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(draft, final, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(final):
                raise VersionTaken(new.version) from e
            raise
        return new

    def _write(self, df: DataFrame, arrivals: tuple[str, ...], rows: int = 0) -> Part:
        """Writes rows as shards, and the part that lists them."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows).parquet(f"{self.root}/{folder}")
        fs, p = hadoop_fs(self.spark, f"{self.root}/{folder}")
        found = [(f.getPath().getName(), f.getLen()) for f in fs.listStatus(p)]
        return self._part([Shard(f"{folder}/{n}", size) for n, size in sorted(found) if n.endswith(".parquet")], arrivals)

    def _part(self, shards, arrivals: tuple[str, ...]) -> Part:
        path = f"parts/{uuid.uuid4().hex}.json"
        self._put(f"{self.root}/{path}", "\n".join(json.dumps(asdict(s)) for s in shards))
        return Part(path, arrivals)

    def append(self, df: DataFrame, arrival: str, rows: int = 2000) -> Manifest:
        """Adds an arrival as shards of ``rows`` rows at most. An arrival that is there already is not added again, so that a failed writer can repeat it.

        Columns that the table hasn't yet are added to it; a column of another type than the table's fails before anything is written.
        If another writer commits first, the shards written are kept and committed on top of its version.
        """
        part, old = None, self.manifest()
        while arrival not in old.arrivals:
            schema = merged_schema(old.schema, df.schema)
            part = part or self._write(df, (arrival,), rows)
            try:
                return self._commit(Manifest(old.version + 1, (*old.parts, part), schema))
            except VersionTaken:
                old = self.manifest()
        return old

    def compact(self) -> Manifest:
        """Merges each tier's shards into files of about the target size, without a shuffle, and commits all merges as one version.

        If another writer commits first, merging begins again from its version.
        """
        while True:
            old = self.manifest()
            shards = self.shards(old)
            kept, made = {s.path: s for s in shards}, []
            for run in self.tiers.merges(shards):
                n = max(1, math.ceil(sum(s.size for s in run) / self.tiers.target))
                made += self.shards(Manifest(0, (self._write(self._read(run, old.schema).coalesce(n), ()),)))
                for s in run:
                    del kept[s.path]
            if not made:
                return old
            try:
                return self._commit(Manifest(old.version + 1, (self._part([*kept.values(), *made], old.arrivals),), old.schema))
            except VersionTaken:
                continue

    def _read(self, shards, schema: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*[f"{self.root}/{s.path}" for s in shards])

    def snapshot(self, version: int | None = None) -> DataFrame:
        """The rows of a version, and the shard that holds each as _shard. A version without shards can't be read."""
        m = self.manifest(version)
        shards = self.shards(m)
        if not shards:
            raise ValueError(f"version {m.version} has no shards")
        df = self._read(shards, m.schema)
        return df.select(*[F.col(f"`{c}`") for c in df.columns], F.regexp_extract("_metadata.file_path", "(data/[^/]+/[^/]+)$", 1).alias("_shard"))

    def vacuum(self, keep: int = 1, older_than: float = 86_400.0) -> int:
        """Deletes shards that only versions before the latest ``keep`` list; how many. Readers of older versions must have ended.

        Also deletes what no version lists, such as the files of a writer that failed, and drafts: once they are ``older_than`` seconds
        old, since a writer may still be about to commit them.
        """
        last = self.version()
        kept = [self.manifest(v) for v in range(max(1, last - keep + 1), last + 1)]
        used = {p.path for m in kept for p in m.parts} | {s.path for m in kept for s in self.shards(m)}
        past = [self.manifest(v) for v in range(1, max(1, last - keep + 1))]
        listed = set()
        for m in past:
            for p in m.parts:
                if self._exists(p.path):
                    listed |= {s.path for s in self.shards(Manifest(0, (p,)))} | {p.path}
        before = (time.time() - older_than) * 1000
        gone = 0
        for folder in ("data", "parts", "manifests"):
            fs, p = hadoop_fs(self.spark, f"{self.root}/{folder}")
            if not fs.exists(p):
                continue
            files = fs.listFiles(p, True)
            while files.hasNext():
                f = files.next()
                path = f"{folder}/" + f.getPath().toString().rsplit(f"/{folder}/", 1)[1]
                manifest = folder == "manifests" and not path.startswith("manifests/draft-")
                if path not in used and not manifest and (path in listed or f.getModificationTime() < before):
                    gone += bool(fs.delete(f.getPath(), False)) and path.endswith(".parquet")
        return gone

    def _exists(self, path: str) -> bool:
        fs, p = hadoop_fs(self.spark, f"{self.root}/{path}")
        return fs.exists(p)


def merged_schema(schema: str, new: StructType) -> str:
    """The table's schema as JSON with the columns that ``new`` adds, all nullable; a column of another type is an error."""
    old = StructType.fromJson(json.loads(schema)) if schema else StructType()
    known = {f.name.lower(): f for f in old.fields}
    out = StructType(list(old.fields))
    for f in new.fields:
        have = known.get(f.name.lower())
        if have is None:
            out = out.add(f.name, f.dataType, True)
        elif have.dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name!r} is {f.dataType.simpleString()}, the table's is {have.dataType.simpleString()}")
    return out.json()


def shard_documents(docs: DataFrame, root: str, tiers: Tiers = Tiers(), arrivals: int = 4) -> DataFrame:
    """Appends documents in ``arrivals`` parts dealt by a hash of doc_id, compacts after every second one, and returns doc_id, shard, version, n_bytes, text_crc32 of each row as the last version holds it.

    All rows and columns are stored as they are: nulls, empty texts and repeated rows too. No rows give no rows.
    """
    store = ShardStore(docs.sparkSession, root, tiers)
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))
    for i in range(arrivals):
        store.append(docs.where(turn == i), f"documents-{i}")
        if i % 2:
            store.compact()
            store.vacuum()
    version = store.compact().version
    store.vacuum()
    text = F.col("text").cast("binary")
    return store.snapshot(version).select("doc_id", F.col("_shard").alias("shard"), F.lit(version).cast("long").alias("version"), F.octet_length(text).cast("long").alias("n_bytes"), F.crc32(text).alias("text_crc32"))
