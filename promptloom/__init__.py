"""promptloom: instruction-data preparation and model-output evaluation as Spark jobs.

Every public operator maps DataFrame -> DataFrame and is expressed with built-in
Spark SQL functions wherever the semantics allow, so Catalyst can prune, push
down and fuse it.  Python runs inside tasks only where a caller-supplied model or
tokenizer, or the Ratcliff-Obershelp similarity, is required.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Python workers may not have this package on their path (a job can be
    launched from anywhere); functions from it are therefore pickled by value."""
    try:
        import sys

        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older cloudpickle: fall back to import by name
        pass


_ship_by_value()
