"""Collects the queries of the plan modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("manifest", "feed", "reading", "sync", "decided", "versions", "matching", "transitions", "analytics", "notices", "pages", "food", "illness", "hazard", "prose", "distribution", "layout", "retailers", "case_facts", "audit")


def _modules() -> list:
    return [import_module(f"noticeworks.plans.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in _modules():
        out.update(m.ORACLES)
    return out
