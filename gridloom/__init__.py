"""Chunked three-dimensional arrays as Spark DataFrames."""

from gridloom.api import create_array, describe_array, open_array, read_array, register, to_array, write_array
from gridloom.grid import bbox_to_region
from gridloom.meta import ArrayMeta, MetadataError

__all__ = ["ArrayMeta", "MetadataError", "bbox_to_region", "create_array", "describe_array", "open_array", "read_array", "register", "to_array", "write_array"]
