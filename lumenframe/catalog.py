"""The registered queries and the SQL that each must equal."""

from __future__ import annotations

from .plans import containers, labels, more, probe, signals, spatial  # noqa: F401
from .plans.common import ORACLE_SQL, QUERIES  # noqa: F401
