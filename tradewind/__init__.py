"""Tradewind: commerce analytics as plain Spark plans.

Raw shop tables go through bronze, silver and gold layers. Every step is a pure
``DataFrame -> DataFrame`` function; only the writers and the medallion run start jobs.
"""

from tradewind.config import Layout, Thresholds

__all__ = ["Layout", "Thresholds"]
