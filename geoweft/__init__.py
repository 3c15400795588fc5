"""geoweft: a Spark-native engine for locating short social posts and preparing their data."""
