"""Registered queries with their SQL oracles, one module per family."""

from importlib import import_module

from evalmill.plans.registry import ORACLES, QUERIES

MODULES = (
    "logprob",
    "uncertainty",
    "joins",
    "strings",
    "pairs",
    "generations",
    "corpus",
    "documents",
    "fewshot",
    "checks",
    "ordering",
    "corpora",
    "io",
    "extension",
    "scoring",
)


def load_all():
    """Import every plan module once and return (queries, oracles)."""
    for name in MODULES:
        import_module(f"evalmill.plans.{name}")
    return dict(QUERIES), dict(ORACLES)
