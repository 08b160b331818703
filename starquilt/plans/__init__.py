"""Registered queries over the driver's tables, with the SQL they are held against."""

from . import algebra_queries, geometry_queries, io_queries, map_queries
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "algebra_queries", "geometry_queries", "io_queries", "map_queries"]
