"""lendscope: credit-risk analytics as Spark DataFrame operators.

Sub-packages
------------
sources    table readers, adapter views, landed-file readers and sinks
functions  column-expression helpers (bands, text formatting, JSON, finance)
operators  DataFrame-in / DataFrame-out operators (quality, features, scoring,
           statistics, drift, roll-ups, alerts, health, registry)
ml         pyspark.ml training / validation of PD and LGD models
streaming  Structured Streaming jobs (windows, keyed state, dedup, scoring)
plans      named end-to-end queries and their DuckDB oracle SQL
"""

__version__ = "0.1.0"
