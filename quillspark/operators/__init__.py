"""The engine's operators: DataFrame in, DataFrame out."""
