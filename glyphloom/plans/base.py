"""The register that the query modules fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function under its own name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


#: SQL for the last delivery of each region, and for its usable confidences.
LATEST_REGIONS = """r AS (SELECT region_id, max_by(struct_pack(video_id := video_id, run_id := run_id, frame_id := frame_id, source_index := source_index, text := text, confidence := confidence, box := box, engine := engine), ingested_at) AS k
 FROM regions WHERE region_id IS NOT NULL GROUP BY region_id),
l AS (SELECT region_id, k.video_id AS video_id, k.run_id AS run_id, k.frame_id AS frame_id, k.source_index AS source_index, k.text AS text, k.confidence AS confidence, k.box AS box, k.engine AS engine FROM r),
u AS (SELECT * FROM l WHERE confidence BETWEEN 0 AND 1 AND NOT isnan(confidence))"""
