"""Lectern: document preparation and reading-study analytics as PySpark jobs."""
