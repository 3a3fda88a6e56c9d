"""Recipe-document analytics on Spark."""
