"""Queries over the driver's tables, a module for each family of operators."""

from . import bitstream, coding, decoder, drc_records, encoder, filterbanks, fixed_point, output, records, replication, replication_syntax, shaping, speech, syntax, transforms  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
