"""tidemark: agent-memory analytics and corpus preparation as Spark DataFrame jobs."""
