"""Traceroute analytics as Spark DataFrame jobs."""

from tracemill.operators import *  # noqa: F401,F403
from tracemill.operators import __all__ as _operators
from tracemill.plans import *  # noqa: F401,F403
from tracemill.plans import __all__ as _plans
from tracemill.sources import *  # noqa: F401,F403
from tracemill.sources import __all__ as _sources

__all__ = sorted([*_operators, *_plans, *_sources])
