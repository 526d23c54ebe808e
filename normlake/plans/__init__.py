"""Registered queries. Importing a plan module fills the registry."""

from importlib import import_module

MODULES = ("retrieval", "scoring", "versions", "routing", "gaps", "documents", "analysis", "reading", "streams", "details", "wording")


def load_all():
    for name in MODULES:
        import_module(f"{__name__}.{name}")
