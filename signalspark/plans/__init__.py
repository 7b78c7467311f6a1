"""Registered queries over the given tables, by group of operators."""

from . import alert_rules, drift, events, features, metrics, recommend, stores, streams, training, vectors  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
