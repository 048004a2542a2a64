"""Panels, layered plans and expression compilers."""
