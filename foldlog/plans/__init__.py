"""The registered queries over the driver's tables and the same queries in SQL."""

from . import commands, folds, stages, streams, tables

QUERIES: dict = {**folds.QUERIES, **tables.QUERIES, **stages.QUERIES, **streams.QUERIES, **commands.QUERIES}
ORACLES: dict = {**folds.ORACLES, **tables.ORACLES, **stages.ORACLES, **streams.ORACLES, **commands.ORACLES}
