"""All registered queries of the reference operators."""

from __future__ import annotations

from loopgrade.plans import curation, learning, market, storage, streams

_FAMILIES = (market, learning, curation, streams, storage)
QUERIES = {k: v for m in _FAMILIES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _FAMILIES for k, v in m.ORACLES.items()}
FLAGSHIP = QUERIES["j_01_rank_recyclers"]
