"""PySpark-native analytics: batch, window, join and streaming plans on the DataFrame API."""
