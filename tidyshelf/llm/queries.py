"""Loads the operators' modules, which register their queries."""

from tidyshelf.llm import bpe, codes, html, jaccard, language, licenses, lines, matroska, mixing, neardup, negatives, neighbours, shards  # noqa: F401
from tidyshelf.llm.common import QUERIES, SQL  # noqa: F401
