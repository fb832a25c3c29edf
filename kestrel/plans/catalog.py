"""Imports every plan module so their queries register themselves."""

from kestrel.plans import beer, cars, churn, digits, funding, mmm, parking, profiling, rides, sales  # noqa: F401
from kestrel.plans.registry import ORACLE, QUERIES  # noqa: F401
