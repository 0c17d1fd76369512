"""Spark-native analytics for paired sensor logs: alignment, quality gates, held-out scoring and paired inference."""
