"""All registered queries of the subpackage."""

from . import (  # noqa: F401  (they register their queries)
    audit,
    chat,
    exact,
    language,
    lexicon,
    manifest,
    neighbours,
    packing,
    quality,
    records,
    simhash,
    substrings,
    token_counts,
)
from .common import REGISTRY

__all__ = ["REGISTRY"]
