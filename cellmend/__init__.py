"""Statistical data cleaning on Spark: detect suspicious cells, propose candidates, learn, repair, evaluate."""
