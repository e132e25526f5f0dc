"""retailflow: a retail real-time warehouse expressed as PySpark DataFrame transforms."""
