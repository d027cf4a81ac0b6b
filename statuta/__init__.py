"""statuta: statute retrieval, answer audit and corpus quality as Spark jobs."""
