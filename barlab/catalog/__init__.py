"""Registered queries: each module maps the driver tables onto one operator family."""

from importlib import import_module

MODULES = (
    "features alignment quality io_tables recursions examples_q specs_q signals_q backtests gates_q boards reports robust_q search_q learning"
).split()


def load_all() -> None:
    for name in MODULES:
        try:
            import_module(f"barlab.catalog.{name}")
        except ModuleNotFoundError as e:
            if f"barlab.catalog.{name}" not in str(e):
                raise
