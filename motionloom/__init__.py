"""motionloom: a Spark-native engine for multi-sensor trajectory analytics."""
