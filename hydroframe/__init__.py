"""hydroframe: Spark-native daily gauge time-series analytics (prepare, readiness, ranking,
windows, metrics, experiment and interpretability summaries) over many stations at once."""

__version__ = "0.1.0"
