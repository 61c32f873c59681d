"""postloom: a Spark-native engine for collected postings and documents."""
