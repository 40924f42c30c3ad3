"""tidemark: question-driven analytics marts on Spark DataFrames.

Every operator takes Spark DataFrames and returns lazy Spark DataFrames built
from built-in Spark SQL expressions. Writing is a separate step (see
``tidemark.sources.sinks``).
"""

from tidemark.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
