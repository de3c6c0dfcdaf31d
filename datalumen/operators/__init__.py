"""Analysis operators; each takes and returns DataFrames."""
