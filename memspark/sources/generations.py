"""Tables that change together: each change writes new files beside the old ones, and one rename makes all of them current.

A generation is a small manifest that says which folders hold each bucket of each table. Readers go by the last manifest, so
a job that dies between any two writes leaves the generation before it, and one that loses a race is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SALTS = 64  # the most tasks that write a bucket


class Conflict(RuntimeError):
    """Another change became current first."""


class Generations:
    """Tables below `root`, in a store that all executors share. Each is dealt into `buckets` by the hash of a key; a manifest
    holds a few paths a bucket, so its size is bounded by tables and buckets, not by rows."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._read: dict[int, bytes] = {}
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def latest(self) -> int:
        """The number of the last generation, 0 before the first."""
        folder = self._path(f"{self.root}/generations")
        if not self._fs.exists(folder):
            return 0
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def manifest(self, generation: int | None = None) -> dict:
        n = self.latest() if generation is None else generation
        if n and n not in self._read:
            stream = self._fs.open(self._path(f"{self.root}/generations/{n:012d}"))
            self._read[n] = bytes(stream.readAllBytes())  # a generation never changes
            stream.close()
        return json.loads(self._read[n]) if n else {}

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def counted(self, *keys: DataFrame) -> dict[int, int]:
        """The buckets that the keys (one column each) lie in, and how many do: at most `buckets` pairs."""
        found = None
        for k in keys:
            own = k.select(self.bucket(F.col(k.columns[0])).alias("b"))
            found = own if found is None else found.unionByName(own)
        return dict(sorted(tuple(r) for r in found.groupBy("b").count().collect()))

    def touched(self, *keys: DataFrame) -> list[int]:
        """The buckets that the keys lie in."""
        return list(self.counted(*keys))

    def read(self, name: str, buckets: list[int] | None = None, schema: StructType | str | None = None, generation: int | None = None) -> DataFrame:
        """A table, or some of its buckets; empty, with the schema given, if there is none of it."""
        held = self.manifest(generation).get(name)
        if held is None:
            return self._nothing(StructType.fromDDL(schema) if isinstance(schema, str) else schema)
        kind = StructType.fromJson(held["schema"])
        paths = [p for b, own in held["files"].items() if buckets is None or int(b) in buckets for p in own]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self._nothing(kind)

    def _nothing(self, kind: StructType) -> DataFrame:
        """No rows, and known to have none: joins with them are planned away, and no task starts Python for them."""
        return self.spark.range(0).where("false").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind])

    def stage(self, name: str, rows: DataFrame, key: str) -> dict:
        """Write rows by bucket of a key into a new folder that no manifest names yet. A bucket is as many tasks' as there are
        rows for; a bucket's folder may hold several files."""
        folder = f"{self.root}/data/{name}-{uuid.uuid4().hex}"
        dealt = rows.withColumn("__bucket", self.bucket(F.col(key)))
        owner = "source" if "source" in rows.columns else key  # rows of one source compress well beside each other
        salt = F.pmod(F.xxhash64(F.lit(1), F.col(owner)), F.lit(SALTS))
        dealt.repartition("__bucket", salt).write.partitionBy("__bucket").parquet(folder)
        parts = [x.getPath().getName() for x in self._fs.listStatus(self._path(folder))]
        files = {n.partition("=")[2]: [f"{folder}/{n}"] for n in parts if n.startswith("__bucket=")}
        return {"schema": json.loads(rows.schema.json()), "files": files}

    def commit(self, base: int, replaced: dict[str, tuple[dict, list[int] | None]] | None = None, added: dict[str, dict] | None = None) -> int:
        """Make staged rows current as the generation after `base`: `replaced` takes the place of the buckets it names (None:
        of all), `added` joins what is there. If another change has come after `base`, nothing happens but Conflict."""
        now = self.manifest(base)
        for name, (staged, buckets) in (replaced or {}).items():
            kept = {b: p for b, p in now.get(name, {"files": {}})["files"].items() if buckets is not None and int(b) not in buckets}
            now[name] = {"schema": staged["schema"], "files": kept | staged["files"]}
        for name, staged in (added or {}).items():
            held = now.setdefault(name, {"schema": staged["schema"], "files": {}})["files"]
            for b, paths in staged["files"].items():
                held[b] = held.get(b, []) + paths
        jvm = self.spark.sparkContext._jvm
        target = self._path(f"{self.root}/generations/{base + 1:012d}")
        draft = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}")
        self._fs.mkdirs(target.getParent())
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        options = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        never_over = self.spark.sparkContext._gateway.new_array(options, 1)
        never_over[0] = options.NONE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            files.rename(self._fs.makeQualified(draft), self._fs.makeQualified(target), never_over)
        except Exception as e:
            if self._fs.exists(target):
                raise Conflict(f"generation {base + 1} is another's") from e
            raise
        return base + 1

    def compacted(self, name: str, rows: DataFrame, key: str) -> int:
        """Make rows, the same table in fewer files, current."""
        base = self.latest()
        return self.commit(base, {name: (self.stage(name, rows, key), None)})
