"""hexatlas: gridded environmental layers, tile pyramids and diversity indices on Spark."""

__version__ = "0.1.0"
