"""Monitors and auditors as streaming queries."""
