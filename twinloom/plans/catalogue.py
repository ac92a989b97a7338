"""All queries of the core and their SQL."""

from __future__ import annotations

from twinloom.plans import audit, bank, code, ledger, model
from twinloom.streaming import cells

QUERIES = audit.QUERIES | bank.QUERIES | code.QUERIES | ledger.QUERIES | model.QUERIES | cells.QUERIES
ORACLE = audit.ORACLE | bank.ORACLE | code.ORACLE | ledger.ORACLE | model.ORACLE | cells.ORACLE
