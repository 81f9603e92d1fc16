"""pairscope: a PySpark-native engine for evaluating paired question-answering experiments."""
