"""shotloom: Spark-native retrieval, timeline and corpus analytics."""
