"""funnelyard — Spark-native funnel, period-comparison and ingestion analytics.

Every public operator is a lazy DataFrame-in / DataFrame-out function built on
Spark SQL expressions; nothing in the library collects data to the driver.
"""

__version__ = "0.1.0"
