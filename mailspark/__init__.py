"""mailspark: PySpark-native analytics for mail corpora (see README.md)."""

__version__ = "0.1.0"
