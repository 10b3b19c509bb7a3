"""paperloom: citation-graph and document analytics expressed as Spark DataFrames."""
