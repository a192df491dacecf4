"""quillwork: data preparation, labelling and dataset-quality operators as Spark DataFrame jobs."""

__version__ = "0.1.0"


def ship_by_value(*others) -> None:
    """Let executors run the Arrow functions of this package (and others) without installing it there."""
    import sys

    from pyspark import cloudpickle

    for module in (sys.modules[__name__], *others):
        cloudpickle.register_pickle_by_value(module)
