"""Entity relationship graphs from text, on Spark."""
