"""Agent-trace analytics and corpus operators as Spark DataFrame programs."""
