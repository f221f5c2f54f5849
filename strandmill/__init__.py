"""strandmill: a Spark-first engine for ordered frame sequences and training corpora."""
