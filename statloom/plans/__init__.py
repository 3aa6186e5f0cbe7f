"""From program text to Spark plans."""
