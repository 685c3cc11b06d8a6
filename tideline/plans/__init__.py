"""Named queries and their SQL counterparts, gathered from the modules of this package."""

from __future__ import annotations

from . import assemble, frames, ingest, models, store, text

MODULES = (store, frames, assemble, text, ingest, models)
QUERIES: dict = {}
ORACLES: dict = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
