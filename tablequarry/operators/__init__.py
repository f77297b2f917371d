"""Discovery operators over flattened lakes: DataFrames in, DataFrames out."""
