"""All queries over the engine's own operators, by name, with equivalent DuckDB SQL."""

from tessera.plans import calibration, corpus, evaluation, extensions, files, forms, gates, judges, rewards, sampling, streams, training  # noqa: F401
from tessera.plans._registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
