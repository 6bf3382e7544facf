"""The engine's operators over the supplied tables, with the same in DuckDB's SQL where that can say it."""

from . import core, data, stored, workload

QUERIES = core.QUERIES | data.QUERIES | stored.QUERIES | workload.QUERIES
ORACLES = core.ORACLES | data.ORACLES | stored.ORACLES | workload.ORACLES
