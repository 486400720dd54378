"""Rule evaluation, evidence fusion and run analytics as Spark plans."""
