"""graphloom: property-graph analytics and record processing on PySpark."""

__version__ = "0.1.0"
