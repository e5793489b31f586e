"""Mail-transport posture analytics expressed as Spark DataFrame operators."""

from mxposture.session import checkpointed, get_session

__all__ = ["checkpointed", "get_session"]
