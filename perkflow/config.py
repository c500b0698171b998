"""Defaults and fixed values.

The block marked FIXED VALUES holds text and numbers that have to equal the
reference application's output exactly (labels, thresholds, window sizes).
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference application's results)
# ---------------------------------------------------------------------------
DEFAULT_HOTEL_THRESHOLD = 5000
DEFAULT_DRINK_THRESHOLD = 1000
DEFAULT_WINDOW = "5 minutes"
DEFAULT_INTERVAL_SECONDS = 300
WATERMARK_DELAY = "10 seconds"
TRANSACTIONS_TOPIC = "gaming-transactions"
WIRE_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"

HOTEL_REWARD_TYPE = "🏨 Complimentary Hotel Room (1 night)"
DRINK_REWARD_TYPE = "🍹 Complimentary Premium Drink"
HOTEL_LABEL = "🏨 Hotel Room"
DRINK_LABEL = "🍹 Free Drink"
NO_REWARD_LABEL = "❌ No Reward"
REDEEMED_BADGE = "✅ Redeemed"
PENDING_BADGE = "⏳ Pending"
SPEND_LABEL_PREFIX = "Spend: $"
LOSS_LABEL_PREFIX = "Lost: $"
HOTEL = "hotel"
DRINK = "drink"
FULFILLMENT_CSV_HEADERS = ("Member ID", "Member Name", "Offer Type", "Fulfilled At")
MEMBERS_CSV_PREFIX = "casino_members_"
TIME_FILTERS = ("Today", "Last Hour", "Last 5 Minutes", "All Time")
DISTRIBUTION_REWARD_NAMES = ("Hotel Room", "Free Drink", "No Reward")
DISTRIBUTION_STATUS_NAMES = ("Winners", "Losers")
# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------

# Deterministic clock used by the registered queries and tests (the
# reference reads the wall clock; here the instant is a parameter).
FIXTURE_AS_OF = "2024-01-16 12:00:00"
FIXTURE_TODAY = "2024-01-16"
FIXTURE_INTERVAL_SECONDS = 86400
