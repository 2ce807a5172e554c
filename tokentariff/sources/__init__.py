from .sessions import SESSION_SCHEMA, TOKEN_COLUMNS, load_sessions, select_sessions
from .staging import kept, shared_folder, staged

__all__ = ["SESSION_SCHEMA", "TOKEN_COLUMNS", "kept", "load_sessions", "select_sessions",
           "shared_folder", "staged"]
