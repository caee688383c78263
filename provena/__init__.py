"""Evidence analytics on Spark: DataFrame operators over facts, documents and hyperedges."""
