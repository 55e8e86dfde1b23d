"""Sources, sinks and their bindings."""

from plumbframe.sources.arrow_ipc import ArrowSink, arrow_bytes, arrow_ipc_binding
from plumbframe.sources.binding import Capabilities, FrameSink, FrameSource, ScanPlan, SinkReceipt, SourceBinding, dataframe_binding, parquet_binding, rows_binding, source_binding, table_binding, write_parquet
from plumbframe.sources.delimited import Coercion, DelimitedOptions, HeaderOptions, Limits, NullPolicy, csv_options, delimited_binding, delimited_path_binding, header_names, header_names_of_path, to_text, tsv_options, write_text

__all__ = ["ArrowSink", "Capabilities", "Coercion", "DelimitedOptions", "FrameSink", "FrameSource", "HeaderOptions", "Limits", "NullPolicy", "ScanPlan", "SinkReceipt", "SourceBinding", "arrow_bytes", "arrow_ipc_binding", "csv_options", "dataframe_binding", "delimited_binding", "delimited_path_binding", "header_names", "header_names_of_path", "parquet_binding", "rows_binding", "source_binding", "table_binding", "to_text", "tsv_options", "write_parquet", "write_text"]
