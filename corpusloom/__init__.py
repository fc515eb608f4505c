"""corpusloom: text-corpus analytics as PySpark DataFrame operators.

Every operator is a function ``f(df, **params) -> DataFrame``; planning and
execution are left to Catalyst and Tungsten.  See README.md for the map.
"""

__version__ = "0.1.0"
