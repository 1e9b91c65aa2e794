"""Column functions of the library."""

from .text import render_task

__all__ = ["render_task"]
