"""Running results over a stream of log lines."""
