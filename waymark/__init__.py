"""Spark-native trajectory analytics: points, stays, tokens, patterns and scores as DataFrame plans."""
