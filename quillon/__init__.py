"""quillon: retrieval, federated SQL and keyed state as Spark DataFrames."""
