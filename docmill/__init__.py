"""docmill: document analytics and data processing expressed as Spark jobs."""
