"""foliomill: document-structure, retrieval and corpus analytics on Spark."""
