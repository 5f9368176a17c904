"""buildproof: Spark-native checks that prove a data build correct before it ships."""
