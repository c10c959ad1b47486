"""tripmesh: batch analytics for trips between a few sites, written for Spark.

Clean departure/arrival records, join vehicles to emission curves, interpolate
by trip duration, spread trips over a minute grid, aggregate and price.
"""

from tripmesh.config import POLLUTANTS, Settings

__all__ = ["POLLUTANTS", "Settings"]
