"""Building plans."""

from larkspur.plans import LogicalPlanBuilder, table_scan, table_scan_with_filters

__all__ = ["LogicalPlanBuilder", "table_scan", "table_scan_with_filters"]
