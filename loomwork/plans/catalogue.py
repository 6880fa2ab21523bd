"""All queries of the library by name, and their SQL."""

from . import activity, builds, corpus, crawl, pages, policies, retrieval, rules, search, sitemaps, supply, tables, visits  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
