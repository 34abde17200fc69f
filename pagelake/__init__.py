"""Crawl-data analytics on Spark DataFrames.

``functions``  column expressions (text, URLs, file names, metric names)
``operators``  DataFrame transformations (extraction, frontier, media, records, statistics)
``sources``    readers and writers
``streaming``  Structured Streaming versions
``plans``      end-to-end jobs and the queries registered with the driver
"""

import sys

from pyspark import cloudpickle

# The few Python helpers travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
