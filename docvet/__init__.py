"""docvet: documentation-research records, verification and taxonomy analytics on Spark.

Every operator takes and returns a ``DataFrame`` or a ``Column``; nothing
collects the data to the driver.
"""

__version__ = "0.1.0"
