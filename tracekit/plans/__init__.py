"""Registered queries per operator family."""

import importlib

FAMILIES = ["trace", "cleaning", "timeline", "scores", "draws", "encoding", "sequences", "usefulness"]


def load_all() -> None:
    for family in FAMILIES:
        importlib.import_module(f"tracekit.plans.{family}")
