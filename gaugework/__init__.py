"""gaugework: benchmark-evidence analytics as Spark jobs."""
