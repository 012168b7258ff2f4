"""Network-flow volume analytics as PySpark DataFrame transforms."""

from flowtusk.plans.detect import DetectionPlan, detect_heavy_flows

__all__ = ["DetectionPlan", "detect_heavy_flows"]
