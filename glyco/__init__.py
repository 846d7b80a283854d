"""glyco: Spark-native analytics for glucose and other per-subject time series.

Every public function takes DataFrames and returns DataFrames; fitted things
(scalers, outlier bounds, series layouts) are small dataclasses of plain
numbers, so the plans they enter stay literal and Catalyst can push them down.
"""
