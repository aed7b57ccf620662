"""All queries of the core and their plain SQL."""

from __future__ import annotations

from . import documents, identity, records, scores, versions

FLAGSHIP = "lint_summary"
QUERIES = {**records.QUERIES, **versions.QUERIES, **identity.QUERIES, **documents.QUERIES, **scores.QUERIES}
SQL = {**records.SQL, **versions.SQL, **identity.SQL, **documents.SQL, **scores.SQL}
