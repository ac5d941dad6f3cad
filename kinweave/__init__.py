"""Analytics over two-coloured parentage graphs, on Spark DataFrames."""
