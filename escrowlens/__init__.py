"""Marketplace, escrow-ledger and chat analytics as Spark jobs.

Every operator is a plain function ``f(tables, **params) -> DataFrame`` built
from DataFrame / Spark SQL expressions.  Nothing is collected to the driver;
where the source system served one caller or one order per call, the operator
here computes every viewer, or applies a whole table of commands, at once.
"""

from escrowlens.session import build_session, work_dir  # noqa: F401

__all__ = ["build_session", "work_dir"]
