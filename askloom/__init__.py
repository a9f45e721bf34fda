"""Retrieval analytics over document corpora, written as Spark DataFrame jobs."""

from askloom.settings import Settings

__all__ = ["Settings"]
