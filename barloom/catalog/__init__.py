"""The registered queries; importing a module registers its queries."""

from importlib import import_module

MODULES = (
    "q_indicators", "q_bars", "q_features", "q_targets", "q_evaluation", "q_decisions", "q_backtest", "q_sources",
    "q_models",
)


def load():
    from barloom.catalog.registry import ORACLES, QUERIES

    for m in MODULES:
        import_module(f"barloom.catalog.{m}")
    return QUERIES, ORACLES
