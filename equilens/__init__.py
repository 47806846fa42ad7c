"""Spark-native counterfactual-audit analytics.

Subpackages: ``sources`` (typed readers and writers), ``functions`` (column
expressions and distribution kernels), ``operators`` (DataFrame operators),
``plans`` (queries over the driver tables with their SQL oracles) and
``streaming`` (Structured Streaming jobs over the same table model).
"""
