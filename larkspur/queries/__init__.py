"""All registered queries of the engine's own operators, and their SQL."""

from . import extras, files, rag, records, telemetry, text, vectors, web, workflow  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401
