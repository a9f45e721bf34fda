"""Registered queries over the given tables, each with its SQL check."""

from __future__ import annotations

import importlib

SECTIONS = ("corpus", "questions", "retrieval", "evaluation", "articles", "fallback", "reporting")


def load():
    """Import all sections and return the filled registry."""
    for section in SECTIONS:
        importlib.import_module(f"askloom.catalog.{section}")
    return importlib.import_module("askloom.catalog.registry")
