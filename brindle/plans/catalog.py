"""All queries of the library by name, and equivalent DuckDB SQL."""

from __future__ import annotations

from brindle.plans import advantage_queries, batch_queries, frame_queries, loss_queries, metric_queries, pipeline_queries, record_queries, reward_queries, stream_queries  # noqa: F401
from brindle.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
