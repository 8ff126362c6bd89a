"""Public-record accountability analytics as Spark DataFrame jobs."""
