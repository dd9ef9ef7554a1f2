"""Checked queries: each Spark query next to the DuckDB SQL it must equal."""

from checks.base import ORACLE, QUERIES  # noqa: F401
from checks import ratings, games, integrity, evidence, jobs, streams, reports, openings, replays, sinks  # noqa: F401
