"""Facts, rules and corpus operators as ordinary Spark DataFrame jobs."""
