"""Operators that reduce or regress panels."""
