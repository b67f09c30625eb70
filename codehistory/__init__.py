"""Analytics of the change history of many source repositories, as Spark jobs."""

from .params import Params

__all__ = ["Params"]
