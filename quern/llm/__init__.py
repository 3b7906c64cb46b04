"""Operators for preparing training text. Nothing else in quern imports this package."""
