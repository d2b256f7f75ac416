"""Readers: CSV, text corpora, bundles, catalogs, metadata, file trees and footers, SQL."""

import sys

from pyspark import cloudpickle

# Functions that open files in tasks travel with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
