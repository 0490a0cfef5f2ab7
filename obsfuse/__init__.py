"""obsfuse: combine, calibrate and judge overlapping uncertain measurements on Spark.

Every operator takes and returns DataFrames.  Sub-packages:

``functions``  column helpers (3-vector / 3x3 algebra, similarity transforms, scalars)
``operators``  joins, grouped fits, fusion, calibration, scoring, ranking
``sources``    ingest jobs, manifests, table and report sinks
``streaming``  append-only admission and incremental aggregates
``plans``      composite pipelines, adapters over the test tables, query catalogue
"""

from obsfuse.runtime import durable, session

__all__ = ["durable", "session"]
__version__ = "0.1.0"
