"""cytolake: Spark-native analytics over large tables of cells and measurements."""
