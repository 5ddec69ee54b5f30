"""PySpark-native analytics for price-bar series: bars, features, labels, models and their evaluation."""
