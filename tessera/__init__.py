"""A Spark-native engine for imagery-segmentation analytics and training-data preparation."""
