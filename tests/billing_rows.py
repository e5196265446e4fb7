"""Small tables of the billing model, written as tuples."""

import datetime as dt
from decimal import Decimal
from types import SimpleNamespace

from burnledger.sources import schemas
from burnledger.sources.tables import conform

D = Decimal


def table(spark, schema, rows):
    """Rows given as dicts; columns left out are NULL, or a fitting text for keys."""
    filled = []
    for row in rows:
        org = row.get("sold_to_organization_name", "A")
        keys = {"organization_name": "SELLER", "sold_to_organization_name": org,
                "sold_to_customer_name": f"Customer {org}", "sold_to_po_number": f"PO-{org}",
                "sold_to_contract_number": f"CNT-{org}"}
        full = {**{n: keys.get(n) for n in schema.names}, **row}
        filled.append(tuple(full[n] for n in schema.names))
    return conform(spark.createDataFrame(filled, schema), schema)


def usage_rows(spark, rows):
    """(org, day, amount[, service type, usage type])."""
    made = []
    for org, day, amount, *kind in rows:
        service, usage_type = (kind + ["WAREHOUSE_METERING", "compute"])[:2] if len(kind) < 2 else kind
        made.append({"sold_to_organization_name": org, "usage_date": day, "usage": D(amount),
                     "usage_in_currency": D(amount), "account_name": f"{org}-1", "usage_type": usage_type,
                     "service_type": service, "currency": "USD", "is_adjustment": False})
    return table(spark, schemas.USAGE, made)


def rate_rows(spark, rows):
    """(org, percentage, from, to[, active])."""
    return table(spark, schemas.MARKUP_RATES, [
        {"sold_to_organization_name": org, "markup_pct": D(pct), "effective_from": first, "effective_to": last,
         "is_active": (rest + [True])[0]} for org, pct, first, last, *rest in rows])


def mapping_rows(spark, rows):
    """(org, locator[, active])."""
    return table(spark, schemas.ACCOUNT_MAPPING, [
        {"sold_to_organization_name": org, "consumer_account_locator": locator, "is_active": (rest + [True])[0]}
        for org, locator, *rest in rows])


def item_rows(spark, rows, start=dt.date(2025, 1, 1)):
    """(org, item, amount, end)."""
    return table(spark, schemas.CONTRACT_ITEMS, [
        {"sold_to_organization_name": org, "contract_item": item, "amount": D(amount), "start_date": start,
         "end_date": end, "expiration_date": end, "currency": "USD"} for org, item, amount, end in rows])


def balance_rows(spark, rows):
    """(org, day, free, capacity, on demand, rollover)."""
    return table(spark, schemas.REMAINING_BALANCE, [
        {"sold_to_organization_name": org, "date": day, "currency": "USD", "free_usage_balance": D(free),
         "capacity_balance": D(capacity), "on_demand_consumption_balance": D(on_demand),
         "rollover_balance": D(rollover), "marketplace_capacity_drawdown_balance": D(capacity) / 10}
        for org, day, free, capacity, on_demand, rollover in rows])


def billing(**tables):
    return SimpleNamespace(**tables)
