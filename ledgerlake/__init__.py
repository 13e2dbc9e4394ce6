"""Bronze / silver / gold fraud analytics as Spark jobs."""
