"""Import every query module so the registry is complete."""

from . import matching_queries  # noqa: F401
from . import reply_queries  # noqa: F401
from . import document_queries  # noqa: F401
from . import learning_queries  # noqa: F401
from . import fuzzy_queries  # noqa: F401
from . import context_queries  # noqa: F401
from . import stream_queries  # noqa: F401
from . import store_queries  # noqa: F401
