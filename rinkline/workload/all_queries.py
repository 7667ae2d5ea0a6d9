"""Every registered query, in one place."""

from rinkline.workload import (  # noqa: F401
    contract_queries,
    model_queries,
    quality_queries,
    scalar_queries,
    season_queries,
    store_queries,
)
from rinkline.workload.registry import QUERIES, SQL  # noqa: F401
