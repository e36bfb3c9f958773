"""Operators that prepare training corpora. Nothing else in the package imports this one."""
