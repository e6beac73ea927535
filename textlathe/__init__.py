"""textlathe: Spark-native preparation, segmentation, graph and retrieval operators for text corpora."""
