"""Geo-localisation analytics over tables and streams, on Spark."""
