"""DataFrame operators: summary, offers, ledger, analytics, ranking."""
