"""Import every plan module so that the registry is filled."""

from tessera.plans import (  # noqa: F401
    clustering, events, forecast, functions, mining, ml, olap, prep, sequences, streaming, text, windows)
from tessera.plans.registry import ORACLE, QUERIES  # noqa: F401
