"""Frame operators: DataFrame in, DataFrame out."""
