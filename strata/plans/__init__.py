"""From declared graphs to DataFrames."""
