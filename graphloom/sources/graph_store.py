"""Graph tables in versions: a commit is one small file that names the parts of both tables, so readers see all of it or none.

A folder holds parts (one for each hash bucket of a table, in folders that are never changed) and manifests, numbered. A manifest is
written under another name and renamed, once all its parts are there; the highest one is the graph. An upsert rewrites only
the buckets that its rows fall into and names the old parts for the others.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stage import staged

#: What makes rows of a table the same.
NODE_KEYS, EDGE_KEYS = ["name", "type"], ["src", "relation", "dst", "doc_id", "chunk_id"]
BUCKETS = 32


class GraphStore:
    """Nodes and edges below one folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str, node_keys: list[str] = NODE_KEYS, edge_keys: list[str] = EDGE_KEYS, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), {"nodes": node_keys, "edges": edge_keys}, buckets

    def _fs(self, path: str) -> tuple:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def versions(self) -> list[int]:
        fs, target = self._fs(f"{self.folder}/manifests")
        if not fs.exists(target):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(target)]
        return sorted(int(x.removesuffix(".json")) for x in names if x.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """Parts of each table by bucket, and the tables' schemas, of a version (the last complete one if none is named)."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise FileNotFoundError(f"no such version of the graph in {self.folder}")
        path = f"{self.folder}/manifests/{known[-1] if version is None else version}.json"
        return json.loads("\n".join(r[0] for r in self.spark.read.text(path, wholetext=True).collect()))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """nodes or edges as of a version."""
        held = self.manifest(version)
        schema = held["schemas"][table]
        paths = [f"{self.folder}/{x}" for x in dict.fromkeys(held[table].values())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucketed(self, table: str, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys[table]), F.lit(self.buckets)).cast("int"))

    def _write(self, table: str, rows: DataFrame) -> dict[str, str]:
        """Writes rows, bucketed, into a new folder; returns its parts by bucket."""
        name = f"{table}/{uuid.uuid4().hex}"
        rows.repartition(self.buckets, "_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{name}")
        fs, target = self._fs(f"{self.folder}/{name}")
        found = [x.getPath().getName() for x in fs.listStatus(target) if x.isDirectory()]
        return {x.removeprefix("_bucket="): f"{name}/{x}" for x in found}

    def done(self, stream: str) -> int:
        """The number of the last batch of a stream that a version holds; -1 if there is none."""
        return self.manifest()["batches"].get(stream, -1) if self.versions() else -1

    def _commit(self, held: dict, version: int, batch: tuple[str, int] | None = None) -> int:
        """The manifest, by a rename that fails if another writer was first."""
        batches = self.manifest()["batches"] if self.versions() else {}
        held = {**held, "batches": batches | ({batch[0]: batch[1]} if batch else {})}
        fs, folder = self._fs(f"{self.folder}/manifests")
        fs.mkdirs(folder)
        _, draft = self._fs(f"{self.folder}/manifests/.{uuid.uuid4().hex}")
        _, final = self._fs(f"{self.folder}/manifests/{version}.json")
        stream = fs.create(draft, True)
        stream.write(json.dumps(held).encode())
        stream.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"version {version} of the graph was written by another writer")
        return version

    def _next(self) -> int:
        return (self.versions() or [0])[-1] + 1

    def refresh(self, nodes: DataFrame, edges: DataFrame) -> int:
        """A version of these tables alone; nodes must be unique by their keys. Returns its number."""
        version = self._next()
        parts = {"nodes": self._write("nodes", self._bucketed("nodes", nodes))}
        self._unique("nodes", nodes.schema.json(), parts["nodes"])
        parts["edges"] = self._write("edges", self._bucketed("edges", edges))
        return self._commit({**parts, "schemas": {"nodes": _ddl(nodes), "edges": _ddl(edges)}}, version)

    def _unique(self, table: str, schema: str, parts: dict[str, str]) -> None:
        if parts:
            rows = self.spark.read.parquet(*(f"{self.folder}/{x}" for x in parts.values()))
            if not rows.groupBy(*self.keys[table]).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
                raise ValueError(f"{table} repeat a key")

    def clear(self) -> int:
        """A version without rows, of the same schemas."""
        return self._commit({"nodes": {}, "edges": {}, "schemas": self.manifest()["schemas"]}, self._next())

    def upsert(self, nodes: DataFrame | None = None, edges: DataFrame | None = None, batch: tuple[str, int] | None = None) -> int:
        """A version with those rows added whose keys are not there yet (the first of each key); returns its number.

        batch: a stream's name and the number of the batch that the rows are, which the same commit notes as done. Present rows stay as they are. Only buckets that new rows fall into are read and written anew. Edges whose ends are no nodes are not added.
        """
        held, version = self.manifest(), self._next()
        out = {"nodes": held["nodes"], "edges": held["edges"], "schemas": held["schemas"]}
        present = None
        for table, rows in (("nodes", nodes), ("edges", edges)):
            if rows is None:
                continue
            if table == "edges":
                present = present if present is not None else self.read("nodes")
                for end in ("src", "dst"):
                    ends = present.select(F.col("name").alias(end), F.col("type").alias(f"{end}_type"))
                    rows = rows.join(ends, [end, f"{end}_type"], "left_semi")
            new = self._bucketed(table, rows.dropDuplicates(self.keys[table]))
            hit = sorted(str(r["_bucket"]) for r in new.select("_bucket").distinct().collect())  # BUCKETS numbers at most
            old = [f"{self.folder}/{held[table][b]}" for b in hit if b in held[table]]
            kept = self.spark.read.schema(held["schemas"][table]).parquet(*old) if old else self.spark.createDataFrame([], held["schemas"][table])
            fresh = staged(new.drop("_bucket").join(kept.select(*self.keys[table]), self.keys[table], "left_anti").select(*kept.columns))
            changed = sorted(str(r["_bucket"]) for r in self._bucketed(table, fresh).select("_bucket").distinct().collect())
            whole = self._bucketed(table, kept.unionByName(fresh)).filter(F.col("_bucket").isin([int(b) for b in changed]))
            out[table] = held[table] | (self._write(table, whole) if changed else {})
            if table == "nodes":
                present = self.read("nodes").unionByName(fresh)
        return self._commit(out, version, batch)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
