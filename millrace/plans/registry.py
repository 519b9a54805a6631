"""Every query of the library, by name, and its SQL where SQL can express it."""

from __future__ import annotations

from millrace.plans import operators, programs, tpch
from millrace.streaming import events

QUERIES = {**tpch.QUERIES, **operators.QUERIES, **programs.QUERIES, **events.QUERIES}
ORACLES = {**tpch.ORACLES, **operators.ORACLES, **programs.ORACLES, **events.ORACLES}
