"""Orders and delivery reports with all their columns: CSV exports, store documents, report documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import exprs as E
from tallyforge.runtime import bucketed
from tallyforge.sources import csvsplit
from tallyforge.sources.intake import action, gid_tail, leading_integer, total

# The export's column names, and the fields of store and report documents.
EXPORT = (
    "ID", "Name", "Created At", "Updated At", "Currency", "Price: Total", "Price: Subtotal", "Price: Total Discount", "Price: Total Shipping", "Payment: Status",
    "Shipping: Country Code", "Billing: Country Code", "Customer: ID", "Line: Type", "Line: Product ID", "Line: Quantity", "Line: Total", "Refund: ID",
)
DOCUMENT = """id string, createdAt string, currencyCode string, presentmentCurrency string, totalPrice string, customer struct<id: string>,
 shippingAddress struct<countryCode: string>, billingAddress struct<countryCode: string>,
 lineItems array<struct<product: string, quantity: long, total: string>>, refunds array<struct<id: string, createdAt: string, amount: string>>"""
REPORT = """ad_id string, adset_id string, campaign_id string, date_start string, spend string, impressions string, reach string, frequency string, clicks string,
 actions array<struct<action_type: string, value: string>>, action_values array<struct<action_type: string, value: string>>"""


def export(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an export; ``Row`` is their order. A quoted value may hold line breaks; a file is still read by many tasks."""
    columns = ", ".join(f"`{c}` string" for c in EXPORT)
    return csvsplit.rows(spark, path, f"`Row` long, {columns}")


def export_orders(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(orders, lines, refunds, rejected). Each order column takes its first value that is not blank; an order without a
    creation time or one of its three prices is rejected with what is missing, and so are its lines and refunds.

    Rows are parsed once and kept by order, so that all four are read in place, without another shuffle."""
    rows = bucketed(rows.withColumn("order_id", F.trim("ID").try_cast("long")).where("order_id IS NOT NULL").drop("ID"), "order_id", "export")
    first = lambda c: F.min_by(F.trim(c), F.when(F.trim(c) != "", F.col("Row")))
    told = rows.groupBy("order_id").agg(*[first(c).alias(c) for c in EXPORT[1:13]])
    currency = F.coalesce("Currency", F.lit("INR"))
    money = lambda c: E.parse_money(F.col(c), currency)
    needed = ("Created At", "Price: Total", "Price: Subtotal", "Price: Total Discount")
    missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), c) for c in needed])
    fine = told.where(missing == "")
    orders = fine.select(
        "order_id", F.col("Name").alias("name"), E.parse_instant(F.col("Created At")).alias("created_at"), E.parse_instant(F.coalesce("Updated At", "Created At")).alias("updated_at"), currency.alias("currency"),
        money("Price: Total").alias("total"), money("Price: Subtotal").alias("subtotal"), money("Price: Total Discount").alias("discount"), money("Price: Total Shipping").alias("shipping"),
        F.lower("Payment: Status").alias("status"), F.coalesce("Shipping: Country Code", "Billing: Country Code").alias("country"), F.col("Customer: ID").try_cast("long").alias("customer_id"),
    )
    items = rows.select("order_id", "Row", "Line: Type", F.col("Line: Product ID").alias("product"), F.col("Line: Quantity").try_cast("long").alias("quantity"), "Line: Total", "Refund: ID").join(orders.select("order_id", "currency"), "order_id")
    line_total = E.parse_money(F.trim("Line: Total"), F.col("currency"))
    lines = items.where(F.col("Line: Type") == "Line Item").select("order_id", "Row", "product", "quantity", line_total.alias("total"))
    back = items.where((F.col("Line: Type") == "Refund Line") & F.col("Refund: ID").isNotNull())
    refunds = back.groupBy("order_id", F.col("Refund: ID").alias("refund_id")).agg(F.sum(F.abs(line_total)).alias("amount"))
    return orders, lines, refunds, told.where(missing != "").select("order_id", missing.alias("missing"))


def document_orders(docs: DataFrame, shop_currency: str = "INR", column: str = "body") -> DataFrame:
    """One row a well-formed store document: the order's own currency, else the one it was shown in, else the shop's; the
    shipping country, else the billing one."""
    o = docs.select(F.from_json(column, DOCUMENT).alias("o")).select("o.*").where(gid_tail(F.col("id")).isNotNull())
    o = o.withColumn("currency", F.coalesce("currencyCode", "presentmentCurrency", F.lit(shop_currency)))
    money = lambda c: E.parse_money(c, F.col("currency"))
    return o.select(
        gid_tail(F.col("id")).alias("order_id"), gid_tail(F.col("customer.id")).alias("customer_id"), "currency", money(F.col("totalPrice")).alias("total"), F.coalesce("shippingAddress.countryCode", "billingAddress.countryCode").alias("country"),
        total(F.col("lineItems"), lambda x: x["quantity"]).alias("units"), F.size(F.coalesce("refunds", F.array())).cast("long").alias("refunds"), total(F.col("refunds"), lambda x: F.abs(money(x["amount"]))).alias("refunded"),
    )


def insights(docs: DataFrame, native_tz: str, reporting_tz: str, currency: str, kind: str = "purchase", column: str = "body") -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): delivery rows by reporting day; a row needs its three ids and a day. Counts read leniently, reach and frequency may be null."""
    r = docs.select(column, F.from_json(column, REPORT).alias("r")).select(column, "r.*")
    ids = [F.coalesce(F.col(c) != "", F.lit(False)) for c in ("ad_id", "adset_id", "campaign_id")]
    fine = ids[0] & ids[1] & ids[2] & F.coalesce(F.col("date_start").try_cast("date").isNotNull(), F.lit(False))
    day = F.col("date_start").try_cast("date")
    whole = lambda c: F.greatest(F.coalesce(leading_integer(c), F.lit(0)), F.lit(0))
    money = lambda c: E.parse_money(c, F.lit(currency))
    rows = r.where(fine).select(
        *[F.col(c).try_cast("long").alias(c) for c in ("ad_id", "adset_id", "campaign_id")], day.alias("native_day"), E.native_day(day, native_tz, reporting_tz).alias("day"), money(F.coalesce("spend", F.lit("0"))).alias("spend"), whole(F.col("impressions")).alias("impressions"),
        F.when(F.col("reach").isNotNull() & (leading_integer(F.col("reach")) >= 0), leading_integer(F.col("reach"))).alias("reach"), F.regexp_extract(F.coalesce("frequency", F.lit("")), r"^\s*([+-]?\d+(?:\.\d+)?)", 1).try_cast("double").alias("frequency"), whole(F.col("clicks")).alias("clicks"),
        *[whole(action("actions", k)).alias(name) for k, name in (("landing_page_view", "landings"), ("add_to_cart", "carts"), ("initiate_checkout", "checkouts"), (kind, "purchases"))], money(action("action_values", kind)).alias("purchase_value"),
    )
    return rows, r.where(~fine).select(column)


def window_calendar(windows: DataFrame, start: str, end: str) -> DataFrame:
    """``windows`` with days, weekend days, their share, and the months touched; an error if one ends before it starts."""
    first, last = F.col(start), F.col(end)
    days = F.when(first > last, F.raise_error(F.lit("a window ends before it starts")).cast("array<date>")).otherwise(F.sequence(first, last, F.expr("interval 1 day")))
    rows = windows.withColumn("_d", days)
    weekend = F.size(F.filter("_d", lambda d: F.dayofweek(d).isin(1, 7)))
    months = F.array_sort(F.array_distinct(F.transform("_d", lambda d: F.date_format(d, "yyyy-MM"))))
    return rows.select(*windows.columns, F.size("_d").alias("days"), weekend.alias("weekend_days"), E.rounded(weekend / F.size("_d"), 6).alias("weekend_share"), F.array_join(months, ",").alias("months"))


def amount(text: Column, currency: Column) -> Column:
    """``parse_money`` that stops at a text it cannot read; null stays null."""
    found = E.parse_money(text, currency)
    return F.when(text.isNull() | found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("not an amount: "), text)).cast("long"))
