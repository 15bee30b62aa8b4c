"""tessera: a Spark-native analytics engine (DataFrame and SQL front doors over Catalyst)."""

from tessera.engine import Engine
from tessera.session import get_session

__all__ = ["Engine", "get_session"]
