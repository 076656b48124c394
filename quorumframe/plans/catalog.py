"""All core queries and their SQL, gathered from the plan modules."""

from __future__ import annotations

from quorumframe.operators import drift
from quorumframe.plans import adjudication, curation, evaluation, executed, files, more, relational, reports, results, structure, texts

QUERIES: dict = {}
SQL: dict = {}
for _m in (relational, adjudication, results, evaluation, texts, curation, structure, more, executed, files, reports, drift):
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
