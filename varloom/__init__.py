"""A Spark-native engine for genotype matrices and training-data pipelines."""
