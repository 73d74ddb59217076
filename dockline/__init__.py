"""Table-level supply-chain analytics expressed as Spark DataFrame plans."""

from dockline.config import DEFAULTS, Settings

__all__ = ["DEFAULTS", "Settings"]
