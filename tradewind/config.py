"""Run settings: where the layers live and where the segments change over."""

from __future__ import annotations

from dataclasses import dataclass

LAYERS = ("raw", "bronze", "silver", "gold")
TABLES = ("customers", "products", "orders", "order_items")


@dataclass(frozen=True)
class Layout:
    """Directory of each layer; a layer sits under ``root`` unless it is named itself."""

    root: str
    raw: str | None = None
    bronze: str | None = None
    silver: str | None = None
    gold: str | None = None

    def path(self, layer: str, table: str | None = None) -> str:
        if layer not in LAYERS:
            raise ValueError(f"unknown layer {layer!r}; expected one of {', '.join(LAYERS)}")
        base = (getattr(self, layer) or f"{self.root.rstrip('/')}/{layer}").rstrip("/")
        return f"{base}/{table}" if table else base


# The segment edges every report is defined with.
@dataclass(frozen=True)
class Thresholds:
    """Edges of the tunable segments, in the order of their labels."""

    order_value: tuple[float, float, float] = (50.0, 150.0, 300.0)
    unit_price: tuple[float, float, float] = (25.0, 100.0, 300.0)
    value: tuple[float, float, float] = (1000.0, 500.0, 100.0)
    frequency: tuple[int, int, int] = (10, 5, 2)
    recency: tuple[int, int, int] = (30, 90, 365)
    sales: tuple[int, int, int] = (100, 50, 10)
    demand: tuple[int, int, int] = (50, 20, 5)
    healthy_silver: float = 85.0
    healthy_gold: float = 90.0
