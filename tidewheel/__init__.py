"""A Spark-native engine for message streams: stores, routing, ordered folds, payloads and streaming forms."""
