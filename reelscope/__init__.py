"""reelscope: a PySpark-native analytics engine for media-inspection data."""
