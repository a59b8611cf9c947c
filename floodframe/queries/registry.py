"""Imports every query module, which registers its queries."""

from floodframe.queries import fixtures  # noqa: F401  isort: skip
from floodframe.queries import catalogue, flows, models, quality, spacetime  # noqa: F401
