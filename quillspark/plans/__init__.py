"""Whole plans, and one query per operator with its SQL."""

from . import queries, reviews  # noqa: F401
