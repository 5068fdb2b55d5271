"""Spark-native text-graph analytics: documents to a versioned hierarchical graph, and retrieval over it."""
