"""Logical plans."""

from larkspur.plans.builder import ContextProvider, LogicalPlanBuilder, OptimizationRule, OptimizerContext, optimize_plan, parse_sql, table_scan, table_scan_with_filters
from larkspur.plans.nodes import Node as LogicalPlan

__all__ = ["ContextProvider", "LogicalPlan", "LogicalPlanBuilder", "OptimizationRule", "OptimizerContext", "optimize_plan", "parse_sql", "table_scan", "table_scan_with_filters"]
