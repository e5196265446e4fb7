"""Table schemas of the billing model."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType, DataType, DateType, DecimalType, StringType, StructField, StructType,
    TimestampNTZType,
)

# 18 digits stay in a long inside Spark rows; wider decimals are slower.
AMOUNT = DecimalType(26, 4)
RATE = DecimalType(18, 2)
BALANCE = DecimalType(18, 2)
QUANTITY = DecimalType(18, 6)
PERCENT = DecimalType(5, 4)

ORG = "sold_to_organization_name"
CUSTOMER = "sold_to_customer_name"
CONTRACT = "sold_to_contract_number"
CONSUMER = "consumer_account_locator"
KEYS = ("organization_name", ORG, CUSTOMER, "sold_to_po_number", CONTRACT)
BALANCE_COLUMNS = ("free_usage_balance", "capacity_balance", "on_demand_consumption_balance",
                   "rollover_balance", "marketplace_capacity_drawdown_balance")


def _table(*fields: tuple[str, DataType] | tuple[str, DataType, bool]) -> StructType:
    return StructType([StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields])


_KEY_FIELDS = tuple((name, StringType()) for name in KEYS)

CONTRACT_ITEMS = _table(
    *_KEY_FIELDS,
    ("start_date", DateType()), ("end_date", DateType()), ("expiration_date", DateType()),
    ("contract_item", StringType()), ("currency", StringType()), ("amount", AMOUNT),
    ("contract_modified_date", DateType()),
)

RATE_SHEET = _table(
    *_KEY_FIELDS,
    ("date", DateType()), ("account_name", StringType()), ("account_locator", StringType()),
    ("region", StringType()), ("service_level", StringType()), ("usage_type", StringType()),
    ("billing_type", StringType()), ("rating_type", StringType()), ("service_type", StringType()),
    ("is_adjustment", BooleanType()), ("currency", StringType()), ("effective_rate", RATE),
)

USAGE = _table(
    *_KEY_FIELDS,
    ("account_name", StringType()), ("account_locator", StringType()), ("region", StringType()),
    ("service_level", StringType()), ("usage_date", DateType()), ("usage_type", StringType()),
    ("currency", StringType()), ("usage", QUANTITY), ("usage_in_currency", QUANTITY),
    ("balance_source", StringType()), ("billing_type", StringType()), ("rating_type", StringType()),
    ("service_type", StringType()), ("is_adjustment", BooleanType()),
)

REMAINING_BALANCE = _table(
    *_KEY_FIELDS,
    ("date", DateType()), ("currency", StringType()),
    *((name, BALANCE) for name in BALANCE_COLUMNS),
)

ACCOUNT_MAPPING = _table(
    (ORG, StringType(), False), (CUSTOMER, StringType(), False), (CONSUMER, StringType(), False),
    ("is_active", BooleanType()), ("created_at", TimestampNTZType()), ("updated_at", TimestampNTZType()),
)

MARKUP_RATES = _table(
    (ORG, StringType(), False), ("markup_pct", PERCENT, False), ("effective_from", DateType(), False),
    ("effective_to", DateType()), ("is_active", BooleanType()),
    ("created_at", TimestampNTZType()), ("updated_at", TimestampNTZType()),
)

TABLES = {
    "partner_contract_items": CONTRACT_ITEMS,
    "partner_rate_sheet_daily": RATE_SHEET,
    "partner_usage_in_currency_daily": USAGE,
    "partner_remaining_balance_daily": REMAINING_BALANCE,
    "account_mapping": ACCOUNT_MAPPING,
    "markup_rates": MARKUP_RATES,
}

# The metered services, with rating class, service name and list rate.
SERVICES = (
    # index, usage_type, rating_type, service_type, list rate
    (1, "compute", "compute", "WAREHOUSE_METERING", "3.00"),
    (2, "cloud services", "compute", "CLOUD_SERVICES", "3.00"),
    (3, "storage", "storage", "STORAGE", "23.00"),
    (4, "automatic clustering", "compute", "AUTOMATIC_CLUSTERING", "3.00"),
    (5, "serverless tasks", "compute", "SERVERLESS_TASK", "3.00"),
    (6, "snowpipe", "compute", "SNOWPIPE", "3.00"),
    (7, "data transfer", "data_transfer", "DATA_TRANSFER", "0.02"),
)
BILLING_TYPE = "consumption"
BALANCE_SOURCE = "capacity"
CAPACITY_ITEM = "capacity"
FREE_ITEM = "free usage"
