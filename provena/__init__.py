"""Provena: evidence analytics over governed document collections, on Spark."""
