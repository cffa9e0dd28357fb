"""Operators that prepare training text at corpus scale; nothing else in the package imports this folder."""
