"""A PySpark engine for market, screening, ledger, filing and thesis analytics."""
