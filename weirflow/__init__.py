"""weirflow: window-join analytics as ordinary Spark DataFrame and Structured Streaming jobs."""
