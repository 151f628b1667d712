"""postlab: post analytics (medallion ETL, EDA queries and ML analytics) on Spark DataFrames.

Subpackages
-----------
sources    -- readers (posts view over the driver tables, typed CSV load, stage read-back) and sinks
functions  -- reusable column expressions (finite guards, safe division, calendar maps)
operators  -- DataFrame -> DataFrame operators (cleaning, features, star schema, EDA, ML stages)
plans      -- compositions of operators: the whole pipeline and the registered query catalogue
streaming  -- the daily-metrics aggregate re-expressed over a Structured Streaming source
"""

__version__ = "0.1.0"
