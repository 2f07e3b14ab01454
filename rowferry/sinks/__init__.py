"""Where records go: a CRM's HTTP interface or files."""

from ..spec import DESTINATION_TYPES
from .crm import CrmSink, register_crm
from .delivery import DeliveryError
from .files import FileSink
from .stream import register_crm_stream, stream_rows

__all__ = ["CrmSink", "FileSink", "create_sink", "register_crm", "register_crm_stream", "stream_rows"]


def create_sink(type: str, **options) -> CrmSink:
    """The sink of a registered destination type; options are those of ``CrmSink``."""
    if type not in DESTINATION_TYPES:
        raise DeliveryError(f"No destination registered for type '{type}'. Available: {', '.join(sorted(DESTINATION_TYPES))}.")
    return CrmSink(type, **options)
