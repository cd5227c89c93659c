"""noteloom: a Spark-first retrieval and analytics engine for note collections."""
