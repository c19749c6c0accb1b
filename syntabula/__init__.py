"""Comparative-genomics table analytics as PySpark DataFrame operators."""
