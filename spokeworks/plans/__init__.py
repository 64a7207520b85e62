"""Named queries over the test tables, with equivalent SQL for checking."""

from spokeworks.plans import payloads, profiles, records, sitemaps, visits, web

_MODULES = (profiles, visits, payloads, web, sitemaps, records)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in _MODULES for name, text in module.SQL.items()}

__all__ = ["QUERIES", "SQL"]
