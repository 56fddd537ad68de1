"""All panel queries; importing the catalogs registers them."""

from . import catalog, catalog_indicators, catalog_io, catalog_market, catalog_research
from .catalog_indicators import flagship

__all__ = ["catalog_indicators", "catalog_io", "catalog_market", "catalog_research", "flagship", "oracle_sql", "queries"]


def queries() -> dict[str, catalog.Query]:
    return dict(catalog.QUERIES)


oracle_sql = catalog.oracle_sql
