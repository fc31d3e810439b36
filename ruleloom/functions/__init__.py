"""Rule functions: each builds Spark columns, nothing runs per row in Python."""
