"""Tandem repeats in large collections of sequences, on Spark."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Task functions travel with their code, so executors need no installed copy.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from .functions.scan import Rule  # noqa: E402
from .plans.jobs import find_repeats, get_repeats, mine_file, single_k_repeats  # noqa: E402
from .sources.chunks import as_sequences, chunk_sequences  # noqa: E402

__all__ = [
    "Rule", "as_sequences", "chunk_sequences", "find_repeats", "get_repeats", "mine_file", "single_k_repeats",
]
