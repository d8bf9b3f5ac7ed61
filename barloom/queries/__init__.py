"""All registered queries of the reference's operators, one key per operator of the inventory."""

from importlib import import_module

MODULES = ("indicators", "joins", "pit", "adjust", "factors", "results", "normalize", "validate", "storage", "revisions")


def load():
    """(queries, oracle SQL) of all modules."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    from .registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
