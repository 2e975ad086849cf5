"""codeloom: a PySpark-native analytics engine over source trees and text tables."""

__version__ = "0.1.0"
