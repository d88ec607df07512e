"""All registered queries."""

from . import agreement, curation, geometry  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
