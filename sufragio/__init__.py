"""sufragio: a Spark-native analytics engine for election results."""
