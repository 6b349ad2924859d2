"""Imports every module that registers queries."""

from importlib import import_module

NAMES: tuple[str, ...] = ("mcq", "scores", "tables", "more", "loaders")


def load_all() -> None:
    for n in NAMES:
        import_module(f"examloom.plans.{n}")
