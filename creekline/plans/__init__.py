"""Whole runs: read, build, write. Each is a short sequence of Spark jobs."""
