"""Entity-by-week panel analytics as PySpark DataFrame operators."""
