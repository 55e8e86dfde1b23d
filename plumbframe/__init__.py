"""plumbframe: a strict, typed dataframe algebra that lowers to Spark DataFrames.

    from plumbframe import Frame, FrameRuntime, Schema, INT32, FLOAT64, count, parquet_binding
"""

import sys

from pyspark import cloudpickle

from plumbframe.errors import ExecutionError, FrameError, OptionError, PlumbError, RuntimeBindingError, SchemaError, SinkError, SourceError, StorageError, TableReadError
from plumbframe.functions import Aggregate, Expr, Nulls, Order, SortKey, asc, count, desc, literal, max_, mean, min_, null_literal, stddev_pop, sum_, variance_pop
from plumbframe.operators import Frame, GroupedFrame, Row
from plumbframe.plans.nodes import Ordering, SourceKind, SourceRef
from plumbframe.plans.requests import ScanRequest, scan_requests
from plumbframe.runtime import EnginePolicy, ExecutionReceipt, FrameRuntime, PushdownReceipt
from plumbframe.sources import ArrowSink, FrameSink, FrameSource, ScanPlan, SourceBinding, arrow_bytes, arrow_ipc_binding, csv_options, dataframe_binding, delimited_binding, delimited_path_binding, header_names, parquet_binding, rows_binding, source_binding, table_binding, to_text, tsv_options, write_text
from plumbframe.table import Table
from plumbframe.types import BOOL, FLOAT32, FLOAT64, INT32, INT64, TIMESTAMP, UTF8, BindingIssue, DataType, Field, Schema, TimeUnit, timestamp

# Functions sent to executors travel by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [n for n in dir() if not n.startswith("_")]
