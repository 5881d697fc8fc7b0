"""Graphs kept on disk for many queries: nodes, steps and degrees in buckets, of which a walk opens those of its frontier.

A put makes one version of all tables (see ``sources.snapshots``): readers see the graph before it or after it. Nodes lie in
the bucket of their name and their ids tell it, steps and degrees in the bucket of the id that they start from, in the
order of ids, so that a hop reads the buckets that its frontier reaches into and, of a short frontier, the row groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import BUCKETS, Snapshot, Snapshots, bucket_of
from ..storage import materialise
from .propagate import Adjacency, between_known, counted_steps, numbered_steps, weighed

#: Up to so many ids are looked up by name, which skips row groups; more of them by their buckets alone.
LISTED = 1000
#: Steps in a file of a bucket, about.
FILE_ROWS = 20_000_000


@dataclass(frozen=True)
class StoredAdjacency(Adjacency):
    """A version of a stored graph. Reads the buckets asked for; whole tables are there as ``nodes``, ``steps``, ``degrees``."""

    snapshot: Snapshot

    def at(self, name: str, ids: DataFrame, column: str) -> DataFrame:
        own = F.pmod(F.col(column), F.lit(BUCKETS)).cast("int") if name == "nodes" else bucket_of(F.col(column))
        wanted = ids.select(F.col(column).alias("id"), own.alias("bucket")).distinct()
        listed = wanted.limit(LISTED + 1).collect()
        if len(listed) <= LISTED:
            rows = self.snapshot.table(name, sorted({r.bucket for r in listed}))
            return rows.filter(F.col("id" if name == "nodes" else "a").isin([r.id for r in listed]))
        return self.snapshot.table(name, sorted(r.bucket for r in wanted.select("bucket").distinct().collect()))

    def named(self, wanted: DataFrame) -> DataFrame:
        return self.snapshot.table("nodes", sorted(r.bucket for r in wanted.select(bucket_of(F.col("node")).alias("bucket")).distinct().collect()))


class GraphStore:
    def __init__(self, spark: SparkSession, path: str):
        self.snapshots = Snapshots(spark, path)

    def put(self, edges: DataFrame, nodes: DataFrame) -> int:
        """Keep ``edges`` (src, dst, relation, confidence) between ``nodes`` (node, is_module) as the newest version: its
        number. Raises ``snapshots.Conflict`` if another writer commits meanwhile; readers of older versions go on."""
        base = self.snapshots.open()
        numbered = "id" in nodes.columns
        number = (F.col("id") if numbered else F.monotonically_increasing_id()) * BUCKETS + bucket_of(F.col("node"))
        known = materialise(nodes.select(number.alias("id"), "node", "is_module"), "nodes")
        if numbered:
            edges = edges.withColumns({f"{end}_id": F.col(f"{end}_id") * BUCKETS + bucket_of(F.col(end)) for end in ("src", "dst")})
        keep = lambda df: materialise(df, "steps")
        steps = weighed(between_known(keep(numbered_steps(edges, known)), known, edges, keep))
        degrees = materialise(counted_steps(steps), "degrees")
        files = max(1, -(-steps.count() // (FILE_ROWS * BUCKETS)))
        tiers = degrees.filter("tier IS NOT NULL").select(F.col("tier").alias("confidence")).distinct()
        written = {
            "nodes": self.snapshots.write("nodes", known, "node", files),
            "steps": self.snapshots.write("steps", steps, "a", files),
            "degrees": self.snapshots.write("degrees", degrees, "a", files),
            "tiers": self.snapshots.write("tiers", tiers, "confidence"),
        }
        return self.snapshots.commit(base, written, list(range(BUCKETS)), {}).version

    def open(self, version: int | None = None) -> StoredAdjacency:
        """The newest version, or the one named; KeyError if there is none."""
        at = self.snapshots.open(version)
        return StoredAdjacency(*(at.table(name) for name in ("nodes", "steps", "degrees", "tiers")), at)
