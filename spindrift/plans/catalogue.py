"""All queries of the engine, by module."""

from spindrift.plans import codec, kernels, parts, scalars, signals  # noqa: F401
from spindrift.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
