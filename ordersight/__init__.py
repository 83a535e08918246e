"""ordersight: order-table analytics on Spark.

Cleans e-commerce order tables, builds per-customer history features with
window functions, expands product bundles, trains Spark ML models and scores
customers. Every operator is a ``DataFrame -> DataFrame`` function usable with
``DataFrame.transform``.
"""

__version__ = "0.1.0"
