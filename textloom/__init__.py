"""textloom: text audit, scoring, drift and planning over tables of documents, on Spark."""
