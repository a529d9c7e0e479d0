"""propval: Spark-native property-listing valuation operators.

Every operator is a ``DataFrame -> DataFrame`` transform built from native
Spark SQL expressions, so the same code runs in batch and in Structured
Streaming and stays inside whole-stage codegen.
"""

from propval.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
