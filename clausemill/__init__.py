"""clausemill: a Spark-native engine for building and querying verifiable clause corpora."""
