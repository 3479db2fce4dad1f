"""Parallel lanes of work: which collide, and what landing them one after another gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import fixed_values as V
from wardline.functions.paths import is_brain_artifact
from wardline.operators.running import chunk_of, running
from wardline.session import broadcast_if_small


def collision_map(lane_files: DataFrame, markers: list[str] | None = None) -> DataFrame:
    """Files more than one lane of a repo touched, with the number of lanes and the first and last.

    Distinct (file, lane) pairs are combined before each shuffle; generated files are left out.
    """
    touched = lane_files.where(~is_brain_artifact(F.col("file"), markers)).select("repo", "file", "lane").distinct()
    return (
        touched.groupBy("repo", "file")
        .agg(F.count("*").alias("lanes"), F.min("lane").alias("first_lane"), F.max("lane").alias("last_lane"))
        .where(F.col("lanes") > 1)
    )


def colliding_lanes(lane_files: DataFrame, markers: list[str] | None = None) -> DataFrame:
    """Every lane with the number of its files and whether any of them collides."""
    touched = lane_files.where(~is_brain_artifact(F.col("file"), markers)).select("repo", "lane", "file").distinct()
    shared = collision_map(lane_files, markers).select("repo", "file", F.lit(1).alias("hit"))
    return (
        touched.join(shared, ["repo", "file"], "left")
        .groupBy("repo", "lane")
        .agg(F.count("*").alias("files"), F.coalesce(F.max("hit"), F.lit(0)).alias("hit"))
        .select("repo", "lane", "files", (F.col("hit") == 1).alias("colliding"))
    )


def sequential_admission(lanes: DataFrame, order: str = "lane") -> DataFrame:
    """Land lanes in order: a conflict halts the repo, a red gate quarantines one lane only.

    ``lanes`` is ``(repo, <order>, commit, conflict, gate_ok)`` with a dense numeric order. The halt
    is the first conflict of a repo (one aggregate); the last good commit before a lane is a running
    value over chunks.
    """
    halts = lanes.groupBy("repo").agg(F.min(F.when(F.col("conflict"), F.col(order))).alias("_halt"))
    outcome = (
        F.when(F.col(order) > F.col("_halt"), "skipped")
        .when(F.col("conflict"), "conflict")
        .when(~F.col("gate_ok"), "quarantined")
        .otherwise("landed")
    )
    judged = (
        lanes.join(broadcast_if_small(halts), "repo")
        .withColumn("outcome", outcome)
        .drop("_halt")
        .withColumn("_landed", F.when(F.col("outcome") == "landed", F.col("commit")))
        .withColumn("_chunk", chunk_of(F.col(order)))
    )
    return running(judged, ["repo"], [order], "_chunk", {"last_good": ("last", "_landed")}).drop("_landed", "_chunk")


def lane_status(outcome: Column) -> Column:
    """Outcomes as the ingest contract names them; anything else reads skipped."""
    return F.when(outcome.isin(V.INGEST_LANE_STATUS), outcome).otherwise("skipped")
