"""Event pipelines on Spark."""

import brookline.operators.load  # noqa: F401
from brookline.operators.registry import OPERATORS
from brookline.plans.frame import Events, events
from brookline.plans.language import Pipeline, dot, run

__all__ = ["OPERATORS", "Events", "Pipeline", "dot", "events", "run"]
