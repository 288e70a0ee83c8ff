"""A versioned store of Parquet tables with atomic publication of deltas.

Rows live in *buckets* by a hash of their memory's id, in all tables alike.  A
publication writes only the buckets that it touches, and then one manifest that says
for every table which version of each bucket holds.  The manifest is created
exclusively, so a reader sees either the old or the new state, and of two writers one
fails.  All files are reached through Hadoop's file system, so that ``root`` may be
any folder that the cluster shares.  Audit records are appended and survive a rebuild.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MEMORIES = "memory_id string, memory_type string, schema_version int, timestamp string, importance double, confidence double, status string, source_kind string, scope string, project string, channel string, hash string, json string, created_at timestamp, updated_at timestamp"
CHUNKS = "chunk_id string, memory_id string, text string, source_path string, line_start int, line_end int, embedding_model_id string, hash string, created_at timestamp"
VECTORS = "chunk_id string, memory_id string, vector array<float>"
POSTINGS = "term string, chunk_id string, memory_id string, pos int, n_terms int"
LENGTHS = "chunk_id string, memory_id string, n_terms int"
AUDIT = "id string, ts timestamp, kind string, payload_json string"
TABLES = {"memories": MEMORIES, "chunks": CHUNKS, "vectors": VECTORS, "postings": POSTINGS, "lengths": LENGTHS}


class _Folder:
    """Small files of a folder in any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def read(self, *parts: str) -> str:
        stream = self.fs.open(self._path(*parts))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, text: str, *parts: str) -> None:
        """Write a new file; an error if it is there already."""
        stream = self.fs.create(self._path(*parts), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, *parts: str) -> None:
        self.fs.delete(self._path(*parts), True)


class Store:
    """Tables under ``root``; made empty with their schemas if they aren't there."""

    def __init__(self, spark: SparkSession, root: str, model_id: str, dim: int, buckets: int = 16) -> None:
        self.spark, self.root, self._files = spark, root.rstrip("/"), _Folder(spark, root)
        if not self.version:
            self._commit({"version": 1, "meta": {"embedding_model_id": model_id, "embedding_dim": str(dim), "buckets": str(buckets)}, "tables": {name: {} for name in TABLES}})
        meta = self.meta()
        if meta["embedding_model_id"] != model_id or int(meta["embedding_dim"]) != dim:
            raise ValueError(f"the index was made with {meta['embedding_model_id']} ({meta['embedding_dim']}), not {model_id} ({dim}): rebuild it")

    def _versions(self) -> list[int]:
        return sorted(int(n[2:-5]) for n in self._files.names("manifests") if n.startswith("v=") and n.endswith(".json"))

    def _manifest(self) -> dict:
        """The newest manifest that is complete; one whose writer is at work or was lost doesn't count."""
        for version in reversed(self._versions()):
            try:
                return json.loads(self._files.read("manifests", f"v={version}.json"))
            except ValueError:
                continue
        return {"version": 0, "meta": {}, "tables": {}}

    def _commit(self, manifest: dict) -> None:
        self._files.create(json.dumps(manifest, sort_keys=True), "manifests", f"v={manifest['version']}.json")

    def _following(self, manifest: dict) -> dict:
        return manifest | {"version": max([manifest["version"], *self._versions()]) + 1}

    def meta(self) -> dict[str, str]:
        return self._manifest()["meta"]

    def set_meta(self, key: str, value: str) -> None:
        manifest = self._manifest()
        self._commit(self._following(manifest) | {"meta": manifest["meta"] | {key: value}})

    @property
    def version(self) -> int:
        return self._manifest()["version"]

    def bucket(self, memory_id: Column) -> Column:
        return F.pmod(F.xxhash64(memory_id), F.lit(int(self.meta()["buckets"]))).cast("int")

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table as it is now, or only some of its buckets."""
        held = self._manifest()["tables"].get(name, {})
        paths = [f"{self.root}/data/{name}/v={v}/bucket={b}" for b, v in sorted(held.items(), key=lambda x: int(x[0])) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def by_id(self, name: str, key: str, value: str) -> DataFrame:
        """The rows of one id; for memories only the bucket that can hold it is read."""
        one = [self.spark.range(1).select(self.bucket(F.lit(value))).first()[0]] if key == "memory_id" else None
        return self.read(name, one).where(F.col(key) == value)

    def publish(self, tables: dict[str, DataFrame], buckets: list[int] | None = None) -> int:
        """Put ``tables`` in the place of ``buckets`` of the same tables (without: of all), as the next version.

        Each table has ``memory_id``.  A large bucket is written by several tasks;
        postings are clustered by term within each file.
        """
        manifest = self._manifest()
        following = self._following(manifest)
        held = {name: dict(own) for name, own in manifest["tables"].items()}
        for name, df in tables.items():
            path = f"{self.root}/data/{name}/v={following['version']}"
            placed = df.withColumn("bucket", self.bucket(F.col("memory_id"))).hint("rebalance", "bucket")
            if name == "postings":
                placed = placed.sortWithinPartitions("bucket", "term", "chunk_id", "pos")
            placed.write.mode("overwrite").partitionBy("bucket").parquet(path)
            kept = {} if buckets is None else {b: v for b, v in held.get(name, {}).items() if int(b) not in buckets}
            written = [n.partition("=")[2] for n in self._files.names("data", name, f"v={following['version']}") if n.startswith("bucket=")]
            held[name] = kept | {b: following["version"] for b in written}
        self._commit(following | {"tables": held})
        return following["version"]

    def rebuild(self, model_id: str, dim: int) -> None:
        """Empty tables for another model; audit records stay."""
        manifest = self._manifest()
        self._commit(self._following(manifest) | {"meta": manifest["meta"] | {"embedding_model_id": model_id, "embedding_dim": str(dim)}, "tables": {name: {} for name in TABLES}})

    def vacuum(self, keep: int = 2) -> int:
        """Delete what none of the newest ``keep`` versions holds; returns the number of folders deleted."""
        versions = self._versions()
        manifests = [json.loads(self._files.read("manifests", f"v={v}.json")) for v in versions[-keep:]]
        gone = 0
        for name in TABLES:
            held = {(str(v), b) for m in manifests for b, v in m["tables"].get(name, {}).items()}
            for folder in self._files.names("data", name):
                version = folder.partition("=")[2]
                if int(version) > versions[-1]:
                    continue  # a publication at work
                for bucket in self._files.names("data", name, folder):
                    if bucket.startswith("bucket=") and (version, bucket.partition("=")[2]) not in held:
                        self._files.delete("data", name, folder, bucket)
                        gone += 1
        for v in versions[:-keep]:
            self._files.delete("manifests", f"v={v}.json")
        return gone

    def append_audit(self, kind: str, payload: dict) -> None:
        self.append_audits(self.spark.createDataFrame([(kind, json.dumps(payload, sort_keys=True))], "kind string, payload_json string"))

    def append_audits(self, records: DataFrame) -> None:
        """Append ``kind, payload_json`` rows with a new id and the time of writing."""
        records.select(F.uuid().alias("id"), F.current_timestamp().alias("ts"), "kind", "payload_json").write.mode("append").parquet(f"{self.root}/audit")

    def audit(self) -> DataFrame:
        """All audit records, in no order; redelivered ones are as often here as they were written."""
        return self.spark.read.schema(AUDIT).parquet(f"{self.root}/audit") if self._files.names("audit") else self.spark.createDataFrame([], AUDIT)


def upsert(current: DataFrame, incoming: DataFrame, key: str, created: str = "created_at") -> DataFrame:
    """``current`` with ``incoming`` rows put in by ``key``; the first ``created`` time of a key is kept."""
    theirs = incoming.select([F.col(c).alias(f"_new_{c}") for c in incoming.columns]).withColumn("_there", F.lit(True))
    both = current.join(theirs, F.col(key) == F.col(f"_new_{key}"), "full")
    keep = lambda c: F.coalesce(c, f"_new_{c}") if c == created else F.when(F.col("_there"), F.col(f"_new_{c}")).otherwise(F.col(c))
    return both.select([keep(c).alias(c) for c in current.columns])


def changed(incoming: DataFrame, current: DataFrame, key: str = "memory_id") -> DataFrame:
    """Incoming rows whose key and hash aren't stored yet: what has to be embedded."""
    return incoming.join(current.select(key, "hash"), [key, "hash"], "left_anti")


def retire(current: DataFrame, seen: DataFrame, key: str = "memory_id") -> DataFrame:
    """``current`` with the status ``archived`` where a key isn't in ``seen`` any more."""
    marks = seen.select(key).distinct().withColumn("_seen", F.lit(True))
    joined = current.join(marks, key, "left")
    return joined.select([F.when(F.col("_seen").isNull(), F.lit("archived")).otherwise(F.col("status")).alias("status") if c == "status" else F.col(c) for c in current.columns])


def set_status(memories: DataFrame, ids: list[str], status: str) -> DataFrame:
    """``memories`` with ``status`` where the id is one of ``ids``; unknown ids change nothing."""
    return memories.withColumn("status", F.when(F.col("memory_id").isin(ids), F.lit(status)).otherwise(F.col("status")))
