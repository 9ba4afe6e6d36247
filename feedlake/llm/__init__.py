"""Operators that prepare language-model training text. Nothing else in the library imports this subpackage."""
