"""Weftline: analytics over a chronological relation of personal activity, on Spark."""
