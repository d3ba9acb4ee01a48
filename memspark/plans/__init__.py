"""Query text to a retrieval plan, and a plan to DataFrames."""
