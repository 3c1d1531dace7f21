"""tabwright: tabular profiling, preparation and model selection on Spark DataFrames.

Every public operator takes a Spark ``DataFrame`` (plus parameters) and returns a
``DataFrame``; work runs on executors through the DataFrame / SQL API and Spark ML.
"""

from tabwright.session import get_spark, checkpoint_dir, cut_lineage  # noqa: F401

__version__ = "0.1.0"
