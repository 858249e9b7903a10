"""All queries of the engine by name, and the SQL that each must agree with."""

from __future__ import annotations

from importlib import import_module

MODULES = ("phrases", "ingest", "entities", "articles", "learning")


def _modules():
    return [import_module(f"presslens.plans.{m}") for m in MODULES]


def queries():
    found = {}
    for m in _modules():
        found |= m.QUERIES
    return found


def oracles():
    found = {}
    for m in _modules():
        found |= m.ORACLES
    return found


def flagship(spark, sf_dir):
    from presslens.plans.phrases import phrase_mi_top

    return phrase_mi_top(spark, sf_dir)
