"""Point-in-time payment analytics as PySpark DataFrame operators."""
