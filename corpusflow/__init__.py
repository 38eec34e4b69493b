"""corpusflow: a Spark-native corpus → chunks → vectors → retrieval → prompt pipeline.

Every public operator takes and returns a DataFrame; nothing is collected to
the driver except bounded, size-checked planning data (index centroids, cell
statistics).
"""

from corpusflow.config import Settings

__all__ = ["Settings"]
