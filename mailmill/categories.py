"""The closed set of categories and the system labels that never count as tags."""

from pyspark.sql import DataFrame, SparkSession

from .schemas import CATEGORY_DIM

# Category names in rank order 1..16.
CATEGORIES = (
    "OTP_AND_VERIFICATION",
    "SECURITY_ALERTS",
    "TRANSACTION_ALERT",
    "REFUNDS_REWARDS",
    "ADS",
    "UPDATES_NEWSLETTERS",
    "AMAZON_PAY",
    "AUTO_DEBIT_REMINDERS",
    "JOB_OPPORTUNITIES",
    "ORDERS_SUBSCRIPTIONS",
    "INVESTMENTS_FINANCIAL_UPDATES",
    "BANKING_FINANCIAL_OFFERS",
    "BANK_STATEMENTS",
    "TRAVEL_AND_EVENTS",
    "SOCIAL_AND_PERSONAL",
    "OTHERS",
)

# What a client is told that the categories mean.
MEANINGS = {
    "OTP_AND_VERIFICATION": "codes and links that prove who someone is",
    "SECURITY_ALERTS": "sign-ins, new devices, changed passwords, exports of an account",
    "TRANSACTION_ALERT": "money that moved into or out of an account or a card",
    "REFUNDS_REWARDS": "money or points given back",
    "ADS": "offers and promotions of shops and services",
    "UPDATES_NEWSLETTERS": "news of services, changed terms, welcome messages, newsletters",
    "AMAZON_PAY": "anything of that wallet, before all other kinds of payment",
    "AUTO_DEBIT_REMINDERS": "payments that will be taken later, mandates",
    "JOB_OPPORTUNITIES": "openings, recruiters, the state of an application",
    "ORDERS_SUBSCRIPTIONS": "orders, deliveries, renewals",
    "INVESTMENTS_FINANCIAL_UPDATES": "funds, shares, dividends, votes of shareholders",
    "BANKING_FINANCIAL_OFFERS": "loans, cards and accounts on offer",
    "BANK_STATEMENTS": "statements of accounts and cards",
    "TRAVEL_AND_EVENTS": "tickets, bookings, itineraries",
    "SOCIAL_AND_PERSONAL": "people: invitations, requests, shared things",
    "OTHERS": "what fits nowhere else",
}

# Labels owned by the mail service.
IGNORED_LABELS = (
    "INBOX", "SENT", "DRAFT", "TRASH", "SPAM", "UNREAD", "STARRED",
    "CHAT", "IMPORTANT", "YELLOW_STAR",
    "CATEGORY_PERSONAL", "CATEGORY_SOCIAL", "CATEGORY_PROMOTIONS",
    "CATEGORY_UPDATES", "CATEGORY_FORUMS",
)

# Fixed value: prefix of the ids of labels made by a user.
CUSTOM_LABEL_PREFIX = "Label_"

FALLBACK_CATEGORY = "OTHERS"


def category_dim(spark: SparkSession) -> DataFrame:
    """Sixteen rows, (rank, category)."""
    return spark.createDataFrame(list(enumerate(CATEGORIES, start=1)), CATEGORY_DIM)
