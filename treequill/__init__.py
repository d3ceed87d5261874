"""Query structured documents with a path and predicate language, compiled to Spark columns."""
