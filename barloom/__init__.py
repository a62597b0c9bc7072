"""Market panel analytics as DataFrame-to-DataFrame Spark jobs."""
