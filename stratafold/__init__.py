"""Event-stream instability analytics on Spark."""
