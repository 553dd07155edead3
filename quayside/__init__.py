"""Fund screening, scoring and portfolio analytics as PySpark DataFrame operators."""
