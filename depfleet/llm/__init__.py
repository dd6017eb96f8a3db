"""Operators on text corpora: tokens, duplicates, leaks, secrets, links, quality, language model, toxicity, pages."""

import sys

from pyspark import cloudpickle

# what tasks run travels with them, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
