"""Schemas, value domains and label styles of the payment-transaction model."""

from __future__ import annotations

from pyspark.sql import types as T

# The domains of the enumerated columns.
TRANSACTION_TYPES = ["P2P", "P2M", "Bill Payment", "Recharge"]
MERCHANT_CATEGORIES = [
    "Food", "Grocery", "Shopping", "Fuel", "Utilities",
    "Entertainment", "Healthcare", "Transport", "Education", "Other",
]
STATUSES = ["SUCCESS", "FAILED"]
AGE_GROUPS = ["18-25", "26-35", "36-45", "46-55", "56+"]
STATES = [
    "Delhi", "Maharashtra", "Karnataka", "Tamil Nadu", "Telangana",
    "Gujarat", "Rajasthan", "West Bengal", "Uttar Pradesh", "Kerala",
    "Punjab", "Haryana", "Madhya Pradesh", "Bihar", "Odisha",
]
BANKS = ["SBI", "HDFC", "ICICI", "Axis", "Kotak", "PNB", "Yes Bank", "IndusInd"]
DEVICES = ["Android", "iOS", "Web"]
NETWORKS = ["3G", "4G", "5G", "WiFi"]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# First hour of Morning, Afternoon, Evening and Night.
DAY_PART_STARTS = {"stored": (5, 12, 17, 21), "dictionary": (6, 12, 18, 22)}

# Spellings of the derived labels.
AMOUNT_TIER_LABELS = {
    "short": {"Small": "Small", "Medium": "Medium", "Large": "Large", "Very Large": "Very Large"},
    "long": {
        "Small": "Small (<500)",
        "Medium": "Medium (500-5000)",
        "Large": "Large (5000-50000)",
        "Very Large": "Large (5000-50000)",
    },
}
AGE_LABELS = {
    "short": {"Young": "Young", "Adult": "Adult", "Old": "Old"},
    "long": {"Young": "Young (18-25)", "Adult": "Adult (26-55)", "Old": "Old (56+)"},
}
AGE_GROUP_TO_LABEL = {
    "18-25": "Young",
    "26-35": "Adult",
    "36-45": "Adult",
    "46-55": "Adult",
    "56+": "Old",
}

# Columns whose values must come from a closed list; NULL is judged by its own rule.
DOMAINS = {
    "transaction_type": TRANSACTION_TYPES,
    "merchant_category": MERCHANT_CATEGORIES,
    "transaction_status": STATUSES,
    "sender_age_group": AGE_GROUPS,
    "receiver_age_group": AGE_GROUPS,
    "sender_bank": BANKS,
    "receiver_bank": BANKS,
    "device_type": DEVICES,
    "network_type": NETWORKS,
}

_S, _I = T.StringType(), T.IntegerType()

TRANSACTIONS = T.StructType([
    T.StructField("transaction_id", _S),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("transaction_type", _S),
    T.StructField("merchant_category", _S),
    T.StructField("amount_inr", _I),
    T.StructField("transaction_status", _S),
    T.StructField("sender_age_group", _S),
    T.StructField("receiver_age_group", _S),
    T.StructField("sender_state", _S),
    T.StructField("sender_bank", _S),
    T.StructField("receiver_bank", _S),
    T.StructField("device_type", _S),
    T.StructField("network_type", _S),
    T.StructField("fraud_flag", _I),
    T.StructField("hour_of_day", _I),
    T.StructField("day_of_week", _S),
    T.StructField("is_weekend", _I),
    T.StructField("day_part", _S),
    T.StructField("amount_tier", _S),
    T.StructField("sender_age_label", _S),
    T.StructField("receiver_age_label", _S),
])
TRANSACTION_COLUMNS = TRANSACTIONS.fieldNames()

# The raw CSV: stored columns without the four derived labels, three under other headers.
SOURCE_RENAMES = {
    "transaction id": "transaction_id",
    "transaction type": "transaction_type",
    "amount (INR)": "amount_inr",
}
DERIVED_LABELS = ["day_part", "amount_tier", "sender_age_label", "receiver_age_label"]
CORRUPT_COLUMN = "_corrupt_record"
_TO_SOURCE = {v: k for k, v in SOURCE_RENAMES.items()}
RAW_CSV = T.StructType(
    [
        T.StructField(_TO_SOURCE.get(f.name, f.name), f.dataType)
        for f in TRANSACTIONS.fields
        if f.name not in DERIVED_LABELS
    ]
)

# Model inputs, in order; the categorical ones are label-encoded.
FEATURE_COLUMNS = [
    "transaction_type", "amount_inr", "sender_bank", "receiver_bank", "device_type",
    "network_type", "sender_state", "hour_of_day", "is_weekend", "day_part",
    "amount_tier", "sender_age_label",
]
CATEGORICAL_COLUMNS = [c for c in FEATURE_COLUMNS if c not in ("amount_inr", "hour_of_day", "is_weekend")]
TARGET_COLUMN = "fraud_flag"

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", _S),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", _S),
])
