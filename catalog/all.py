"""Importing this module registers every query."""

from catalog import analytics  # noqa: F401
from catalog import text  # noqa: F401
from catalog import normalized, writes  # noqa: F401
from catalog import streams  # noqa: F401
