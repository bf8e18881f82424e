"""kinloom: a Spark-first engine for record linkage and the analytics around it."""
