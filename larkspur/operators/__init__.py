"""Operators beyond single DataFrame calls."""

from larkspur.operators.windows import groups_frame

__all__ = ["groups_frame"]
