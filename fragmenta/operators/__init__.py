"""Operators over catalogs, fragments, nodes and audit logs."""
