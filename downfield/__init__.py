"""Play-by-play analytics and corpus preparation as Spark DataFrame functions."""
