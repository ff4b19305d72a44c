"""All registered queries; importing the modules fills ``REGISTRY``."""

from .registry import REGISTRY, Query, query  # noqa: F401
from . import row_level, dataset_level, profiling, io, streams, flagship  # noqa: F401,E402

FLAGSHIP = "apply_rules_end_to_end"
