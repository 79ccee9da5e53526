"""Dataset cleaning, profiling and dashboard feeds as Spark jobs."""
