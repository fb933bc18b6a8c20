"""quillfold: text curation, style measurement, listing ranking and event-log folding on Spark."""
