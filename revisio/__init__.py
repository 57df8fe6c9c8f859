"""revisio: build, prepare and score instruction-style text-edit corpora on Spark.

Every public operator is ``DataFrame -> DataFrame`` or returns a ``Column``.
Randomness is a pure function of (seed, stream, row id, purpose, ordinal),
so results do not depend on partitioning, task retries or executor loss.
"""
__version__ = "0.1.0"
