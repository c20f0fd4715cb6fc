"""Profile search, matching, page extraction and application tracking as Spark DataFrame operators."""
