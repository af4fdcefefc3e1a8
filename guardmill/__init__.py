"""Governed document analytics as Spark jobs."""

from guardmill.contracts import Contracts, default_contracts, read_contracts

__all__ = ["Contracts", "default_contracts", "read_contracts"]
