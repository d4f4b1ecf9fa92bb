from colforge.queries import check_ops, duplicate_ops, ingest_ops, io_ops, ordered_ops, sql_ops  # noqa: F401
from colforge.queries.base import QUERIES

__all__ = ["QUERIES"]
