"""Tessera: relational evidence analytics on Spark."""
