"""Message and event sources, and report and alert sinks."""
