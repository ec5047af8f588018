"""All registered queries; importing the modules fills the registry."""

from tradewind.catalog.registry import QUERIES

__all__ = ["QUERIES"]
