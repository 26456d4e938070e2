"""Optimizing plans."""

from larkspur.plans import OptimizationRule, OptimizerContext, optimize_plan

__all__ = ["OptimizationRule", "OptimizerContext", "optimize_plan"]
