"""perkflow: loyalty-rewards analytics as Spark DataFrame jobs.

Transactions (bet / win / cashout rows) are rolled into per-member tumbling
window totals; reward offers, a one-per-member-per-day redemption ledger and
the dashboard questions around them are plain DataFrame functions that run
the same way in batch and in Structured Streaming.
"""

__version__ = "0.1.0"
