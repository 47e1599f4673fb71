"""Public-opinion analytics as DataFrame-to-DataFrame Spark jobs."""
