"""hoplite: labelled directed multigraphs and k-hop counting on Spark DataFrames."""
