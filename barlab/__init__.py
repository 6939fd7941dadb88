"""barlab: Spark-native strategy research over daily market-style bars."""

__version__ = "0.1.0"
