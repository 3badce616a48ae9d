"""Registered queries on the driver's tables, each with equivalent SQL where SQL can say it."""

from offerloom.queries import archives, cases, catalogue, compare, fields, files, ingests, pages, publishing, tables

QUERIES = compare.QUERIES | catalogue.QUERIES | tables.QUERIES | fields.QUERIES | pages.QUERIES | ingests.QUERIES | files.QUERIES | cases.QUERIES | archives.QUERIES | publishing.QUERIES
ORACLES = compare.ORACLES | catalogue.ORACLES | tables.ORACLES | fields.ORACLES | pages.ORACLES | ingests.ORACLES | files.ORACLES | cases.ORACLES | archives.ORACLES | publishing.ORACLES
