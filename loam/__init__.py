"""Knowledge-base analytics on Spark: notes, chunks, retrieval, link graph, chat archives and monitoring as DataFrames."""
