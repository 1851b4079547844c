"""All registered queries."""

from . import queries_relational  # noqa: F401
from . import queries_features  # noqa: F401
from . import queries_scoring  # noqa: F401
from .registry import COVERS, ORACLES, QUERIES  # noqa: F401
