"""Missing-key comparison and deployment catalogs as Spark jobs."""
