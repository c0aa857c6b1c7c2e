"""Connected components of an edge table, by the engine's own operator."""

from __future__ import annotations

from quirewise.operators.graph import components as connected_components

__all__ = ["connected_components"]
