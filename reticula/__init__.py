"""A PySpark-native analytics engine for rooted trees and reticulate networks."""
