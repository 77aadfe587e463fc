"""Every registered sensor query; importing the modules registers them."""

from . import estimates as _estimates  # noqa: F401
from .sensor import QUERIES

__all__ = ["QUERIES"]
