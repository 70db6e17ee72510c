"""Operators for preparing training text at scale, beside the telemetry engine.

Nothing outside this subpackage imports it.  Each operator takes and returns
DataFrames; ``queries`` holds the registered ``opN_<name>`` queries.
"""
