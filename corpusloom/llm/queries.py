"""All registered queries of this subpackage and their DuckDB twins."""

from corpusloom.llm import (bpe, embedding_dedup, exact_dedup, hard_negatives, minhash, mixing, pii, quoting, resampling,  # noqa: F401
                            sharding, simhash, tokenfile, toxicity)
from corpusloom.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
