"""recollect: agent-memory analytics as lazy Spark plans."""
