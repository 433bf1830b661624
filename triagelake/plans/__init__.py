"""Composed queries by family; each module holds QUERIES and the SQL to check them."""

from triagelake.plans import audit, branches, chain, evidence, ingest, live, reason, scoring, sessions, stages

FAMILIES = (ingest, chain, scoring, evidence, reason, branches, sessions, audit, stages, live)
