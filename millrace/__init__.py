"""A Spark-native analytics engine: frames, SQL sessions, node pipelines and table I/O."""
