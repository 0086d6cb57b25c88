"""Survey-data editing, analytics and metadata search on Apache Spark."""
