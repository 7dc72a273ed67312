"""Find which scripts read, write, create or drop a table, as Spark jobs."""
