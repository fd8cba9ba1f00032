

from . import naming, queries

__all__ = ["naming", "queries"]
