"""Sparse multi-resolution sky maps as Spark relations."""

from .operators.geometry import Box, Circle, Ellipse, Polygon, realize_geom
from .operators.sampling import make_uniform_randoms, make_uniform_randoms_fast
from .operators.skymap import SkyCoverage, SkyMap

__all__ = ["Box", "Circle", "Ellipse", "Polygon", "SkyCoverage", "SkyMap", "make_uniform_randoms", "make_uniform_randoms_fast", "realize_geom"]
