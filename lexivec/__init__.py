"""lexivec: opinion mining and word-vector analytics as Spark DataFrame jobs.

Every operator is a function ``DataFrame -> DataFrame`` (use with
``df.transform``) or a column helper ``Column -> Column``.  Nothing runs on the
driver except plan construction and size checks of tables that are broadcast.
"""

__version__ = "0.1.0"
