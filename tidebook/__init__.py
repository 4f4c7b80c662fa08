"""Order-book and event-stream analytics on Spark."""
