"""Queries over the driver's tables, with the SQL they must agree with."""

from . import catalog, cluster, coding, signals, store, text

MODULES = (text, cluster, signals, coding, catalog, store)
