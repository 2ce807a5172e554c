from .calls import stream_calls, stream_sessions_from_calls
from .distribution import stream_distribution
from .sessions import stream_sessions

__all__ = ["stream_calls", "stream_distribution", "stream_sessions", "stream_sessions_from_calls"]
