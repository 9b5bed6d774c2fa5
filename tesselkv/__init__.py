"""tesselkv: versioned key-value analytics as Spark DataFrame transformations.

Set operators are plain ``DataFrame -> DataFrame`` functions; only the store and
its transactions keep state.  ``now`` and ``read_ts`` are always parameters, so a
result never depends on the clock.
"""

__version__ = "0.1.0"
