"""All queries of this subpackage and their SQL."""

from . import byte_bpe, collocations, conversation_repair, decontaminate, language, linededup, personal_data, quality_rules, sharding, simhash, suffix_dedup, toxicity, urlfilter  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
