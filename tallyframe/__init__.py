"""tallyframe: a Spark-first analytics engine.

``Frame`` wraps one DataFrame, ``FrameManager`` wraps one SparkSession; every operator is a function from DataFrame to
DataFrame, so Catalyst sees one declarative plan per query.
"""

from tallyframe.frame import Frame
from tallyframe.manager import FrameManager

__all__ = ["Frame", "FrameManager"]
