"""cohortspark: statistics over vertically partitioned tables, and corpus work, as Spark jobs."""
