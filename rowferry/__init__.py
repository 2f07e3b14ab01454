"""rowferry: move the right rows of warehouse tables into operational systems.

Every operator takes and returns DataFrames (or Columns) and stays lazy; the
few actions live in ``plans`` and ``streaming``.
"""

from .spec import AgentSpec, FieldMap, SyncSpec, field_maps

__all__ = ["AgentSpec", "FieldMap", "SyncSpec", "field_maps"]
