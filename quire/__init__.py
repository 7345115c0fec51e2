"""quire: document analytics, hybrid retrieval and corpus preparation as Spark plans."""
