"""Where log lines and parsed rows come from, and where they are kept."""
