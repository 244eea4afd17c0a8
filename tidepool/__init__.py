"""tidepool — Spark-native dataset preparation, windowing, scaling, model fitting and evaluation.

Every operator is a plain ``DataFrame -> DataFrame`` function (sometimes returning a small
fitted-parameter object as well). Order-dependent operators take an explicit ``order_by`` that
must be a total order (include a unique tie-breaker) and optional ``partition_by`` series keys.
"""

__version__ = "0.1.0"
