"""Panel time-series analytics as Spark DataFrame transformations."""

from paneltide.spec import PanelSpec

__all__ = ["PanelSpec"]
