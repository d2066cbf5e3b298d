"""All queries of the library and their SQL."""

from . import halo_queries, mesh_queries, scalar_queries, tree_queries, io_queries  # noqa: F401
from .base import QUERIES, SQL

QUERIES["mass_function"], SQL["mass_function"] = QUERIES["a23_mass_function"], SQL["a23_mass_function"]
