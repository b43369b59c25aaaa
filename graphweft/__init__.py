"""Property-graph analytics and question-driven retrieval as Spark plans."""
