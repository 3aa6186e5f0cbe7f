"""Statistical data processing on Spark: ordered row steps, a missing-aware SQL dialect,
summary procedures, functions, formats and a macro layer."""
