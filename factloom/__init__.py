"""factloom: document, fact-graph and retrieval analytics expressed as Spark plans."""
