"""The queries over the given tables. Importing the package registers all of them."""

from . import acquisition, catalog, regions, runs  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
