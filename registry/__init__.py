"""The registered queries: each operator bound to the given tables, beside its SQL.

Importing this package fills QUERIES and ORACLES.
"""

from registry import (  # noqa: F401
    aggregate_queries,
    catalogue_queries,
    history_queries,
    link_queries,
    merge_queries,
    quality_queries,
    rule_queries,
    scalar_queries,
    source_queries,
    stream_queries,
    territory_queries,
)
from registry.core import ORACLES, QUERIES  # noqa: F401
