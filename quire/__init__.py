"""quire: a PySpark-native engine for structure-preserving processing of packaged documents."""
