"""parcela: Spark-native analytics for ensembles of graph partitions."""
