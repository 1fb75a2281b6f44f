"""A stored vector collection with payload fields: create, exists, reset, scroll, filtered search, upsert.

Points are partitioned by the payload fields that most searches filter on, bucketed by id and sorted by the payload, so a
filter prunes folders and row groups, and an upsert meets the stored rows bucket by bucket without an exchange of them.
Each change writes a new version beside the old one and then names it current: a lost executor or a failed write leaves the
old version in force, and readers of it are not disturbed.
"""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from gleanery.operators import dense
from gleanery.operators.ranking import top_k

PAYLOAD = ("page_type", "source", "chunk_strategy", "faculty_rank", "course_code")
PARTITIONED = PAYLOAD[:2]
_MISSING = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


class VectorCollection:
    """Points (id, embedding, the payload fields and any others) below ``path``, which executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        """``buckets``: as many as exchanges have partitions, or Spark would rather move the stored side than join by few buckets."""
        self.spark, self.path = spark, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    # --- life cycle ---------------------------------------------------------------------------------
    def _current(self) -> tuple[int, int, str] | None:
        """(version, buckets, schema) in force."""
        try:
            about = self.spark.read.option("recursiveFileLookup", "true").schema("version int, buckets int, columns string").parquet(f"{self.path}/about")
            return tuple(about.orderBy(F.desc("version")).first() or ()) or None
        except AnalysisException as e:
            if e.getCondition() not in _MISSING:
                raise
            return None

    def exists(self) -> bool:
        return self._current() is not None

    def create(self, points: DataFrame, overwrite: bool = False) -> bool:
        """Store ``points`` unless the collection exists; says whether it wrote."""
        if self.exists() and not overwrite:
            return False
        missing = [F.lit(None).cast("string").alias(c) for c in PAYLOAD if c not in points.columns]
        self._write(points.select("*", *missing))
        return True

    def reset(self) -> None:
        """Leave the collection empty, with the columns it had."""
        points = self.points()
        self._write(self.spark.createDataFrame([], points.schema))

    def _write(self, points: DataFrame) -> None:
        current = self._current()
        version = current[0] + 1 if current else 1
        rest = [c for c in PAYLOAD if c not in PARTITIONED]
        name = f"points_{uuid4().hex}"
        (points.write.partitionBy(*PARTITIONED).bucketBy(self.buckets, "id").sortBy(*rest, "id").option("path", f"{self.path}/v{version}").saveAsTable(name))
        self.spark.sql(f"DROP TABLE {name}")  # the files stay: the table is external
        about = self.spark.createDataFrame([(version, self.buckets, points.schema.json())], "version int, buckets int, columns string")
        about.coalesce(1).write.parquet(f"{self.path}/about/{version}")

    # --- reading ------------------------------------------------------------------------------------
    def points(self) -> DataFrame:
        """All points of the current version, known to Spark as bucketed."""
        current = self._current()
        if current is None:
            raise ValueError(f"no collection below {self.path}")
        version, buckets, columns = current
        schema = T_.StructType.fromJson(json.loads(columns))
        last = [schema[c] for c in PARTITIONED]
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*(f for f in schema if f.name not in PARTITIONED), *last])
        name = f"points_{uuid4().hex}"
        sort = ", ".join(f"`{c}`" for c in (*(c for c in PAYLOAD if c not in PARTITIONED), "id"))
        self.spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet PARTITIONED BY ({', '.join(PARTITIONED)}) "
                       f"CLUSTERED BY (id) SORTED BY ({sort}) INTO {buckets} BUCKETS LOCATION '{self.path}/v{version}'")
        self.spark.catalog.recoverPartitions(name)
        return self.spark.table(name).select(*schema.names)

    def count(self) -> int:
        return self.points().count()

    def scroll(self, **payload: str) -> DataFrame:
        """Points with the given payload values, without their vectors; a value of None asks for nothing."""
        points = self.points()
        return points.where(matches(payload)).drop("embedding")

    def search(self, queries: DataFrame, k: int, threshold: float = 0.0, **payload: str) -> DataFrame:
        """Ranked (query_id, id, score, rank) among the points with the given payload values."""
        return dense.search(self.points(), queries, k, matches(payload), threshold)

    # --- change -------------------------------------------------------------------------------------
    def merged(self, incoming: DataFrame, version: str | None = None) -> DataFrame:
        """Stored points with the incoming ones in place of those of the same id; of several incoming the latest ``version``."""
        stored = self.points()
        if version:
            incoming = top_k(incoming, ["id"], [F.col(version).desc()], 1, "_place").drop("_place", version)
        fresh = incoming.select(*(F.col(c) if c in incoming.columns else F.lit(None).cast(stored.schema[c].dataType).alias(c) for c in stored.columns))
        new = fresh.select("id", F.struct(*(c for c in stored.columns)).alias("new")).hint("merge")
        both = stored.select("id", F.struct(*stored.columns).alias("old")).join(new, "id", "full_outer")
        return both.select(F.coalesce("new", "old").alias("row")).select("row.*")

    def upsert(self, incoming: DataFrame, version: str | None = None) -> bool:
        """Merge ``incoming`` into the collection; nothing is written when every incoming point is stored as it is."""
        stored = self.points()
        same = [c for c in stored.columns if c in incoming.columns]
        digest = F.xxhash64(*same).alias("digest")
        if not incoming.select("id", digest).join(stored.select("id", digest).hint("merge"), ["id", "digest"], "left_anti").limit(1).count():
            return False
        self._write(self.merged(incoming, version))
        return True

    def needs_build(self, chunks: DataFrame) -> bool:
        """Whether the collection is missing or holds fewer points than there are chunks."""
        return not self.exists() or self.count() < chunks.count()


def matches(payload: dict[str, str]) -> Column:
    unknown = set(payload) - set(PAYLOAD)
    if unknown:
        raise ValueError(f"no payload field {sorted(unknown)}")
    test = F.lit(True)
    for name, value in payload.items():
        if value is not None:
            test = test & (F.col(name) == value)
    return test
