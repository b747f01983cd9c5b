"""DataFrame operators: DataFrame in, DataFrame out, no I/O."""
