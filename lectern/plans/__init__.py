"""Query catalogs; importing the package registers the queries of all of them."""

from lectern.plans import articles, catalog, markup, notes, operations, routing

__all__ = ["articles", "catalog", "markup", "notes", "operations", "routing"]
