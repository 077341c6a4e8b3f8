"""Subpackage of the engine; see the module docstrings."""
