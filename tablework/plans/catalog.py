"""All registered queries, family by family."""

from __future__ import annotations

import importlib

from tablework.plans.common import Registry

FAMILIES = (
    "tablework.plans.q_prepare",
    "tablework.plans.q_filters",
    "tablework.plans.q_aggregate",
    "tablework.plans.q_profile",
    "tablework.plans.q_quality",
    "tablework.plans.q_series",
    "tablework.plans.q_facts",
    "tablework.plans.q_opensql",
    "tablework.plans.q_windows",
    "tablework.plans.q_runlog",
    "tablework.plans.q_sources",
    "tablework.plans.q_stored",
)

_REGISTRY: Registry | None = None


def registry() -> Registry:
    global _REGISTRY
    if _REGISTRY is None:
        reg = Registry()
        for mod in FAMILIES:
            importlib.import_module(mod).register(reg)
        _REGISTRY = reg
    return _REGISTRY
