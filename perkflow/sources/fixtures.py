"""Deterministic redemption requests for tests and the registered queries.

The reference records redemptions when a cashier ticks an offer; there is no
stored history to read. The fixture simulates that desk: every qualifying
offer window of an accepting member produces one redemption request at the
window's end. All offers are read; the rule only decides who accepts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkflow import config

# ---------------------------------------------------------------------------
# FIXED VALUES (fixture rule; the golden ledger and pending counts depend on it)
# members with member_id % 3 == 0 accept hotel offers,
# members with member_id % 3 == 1 accept drink offers
# ---------------------------------------------------------------------------
ACCEPT_MODULUS = 3
HOTEL_ACCEPT_REMAINDER = 0
DRINK_ACCEPT_REMAINDER = 1
# ---------------------------------------------------------------------------


def simulated_requests_from_rows(rows: DataFrame) -> DataFrame:
    """Same rule over single-pass offer rows (offers.offer_rows)."""
    m = F.col("member_id") % ACCEPT_MODULUS
    t = F.col("offer_type")
    accepts = ((t == config.HOTEL) & (m == HOTEL_ACCEPT_REMAINDER)) | \
              ((t == config.DRINK) & (m == DRINK_ACCEPT_REMAINDER))
    return rows.where(accepts).select("member_id", "member_name", "offer_type",
                                      F.col("window_end").alias("requested_at"))
