"""Queries of the subpackage by name, and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("p1_splits", "p2_names", "p3_lines", "p4_terms", "p5_near", "p6_forms", "p7_phrases", "p8_encode", "p9_leaks", "p10_pieces")


def queries():
    found = {}
    for name in MODULES:
        found |= import_module(f"presslens.llm.{name}").QUERIES
    return found


def oracles():
    found = {}
    for name in MODULES:
        found |= getattr(import_module(f"presslens.llm.{name}"), "ORACLES", {})
    return found
