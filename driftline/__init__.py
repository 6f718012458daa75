"""driftline: a PySpark-native analytics engine for moving objects.

Everything is expressed as lazy DataFrame plans.  The append-only table of
updates is the single source of truth; current state, spatial queries,
trajectories and the cleaning operators are derived from it.
"""

__version__ = "0.1.0"
