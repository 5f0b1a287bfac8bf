"""Table-in, table-out operators. DataFrame in, DataFrame out, no I/O."""
