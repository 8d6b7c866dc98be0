"""Operators for preparing training text at scale; nothing else in netloom imports this package."""
