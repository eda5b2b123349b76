"""loamgraph: a Spark-first analytics engine for captures, knowledge graphs and their embeddings."""
