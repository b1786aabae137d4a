"""scorelens: Spark-native building, checking and monitoring of binary-target
scoring models (credit-risk style).

Every public operator takes Spark DataFrames and returns a DataFrame whose plan
Catalyst optimises; actions happen only where an edge list or a schema depends
on the data (documented per function).
"""

from scorelens.spec import FeatureSpec

__all__ = ["FeatureSpec"]
