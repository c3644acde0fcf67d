"""Operators for cleaning training text; nothing else in the library imports this subpackage."""
