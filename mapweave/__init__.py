"""mapweave: Spark-native crosswalk analytics between two requirement tables."""
