"""Registered queries; importing this package registers them all."""

from . import archives, coverage, identity, manifests, members, metadata, overlap, records, runs  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
