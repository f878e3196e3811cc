"""Value-added-tax compliance and ledger reconciliation as Spark DataFrame jobs."""

__version__ = "0.1.0"
