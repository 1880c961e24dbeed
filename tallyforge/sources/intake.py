"""Orders and ads reports as they arrive (CSV exports, store JSON, report JSON), parsed into facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import exprs as E
from tallyforge.runtime import bucketed
from tallyforge.sources import csvsplit

CSV_COLUMNS = "`Row` long, `ID` string, `Name` string, `Created At` string, `Customer: ID` string, `Line: Type` string, `Line: Product ID` string, `Line: Quantity` string, `Line: Total` string, `Refund: ID` string"

STORE_ORDER = """id string, createdAt string, customer struct<id: string>,
 lineItems array<struct<product: string, quantity: long, total: string>>,
 refunds array<struct<id: string, transactions: array<struct<kind: string, status: string, amount: string>>, lines: array<struct<subtotal: string, tax: string>>>>"""

REPORT_ROW = """ad_id string, date_start string, spend string, impressions string, clicks string, attribution_setting string,
 actions array<struct<action_type: string, value: string>>, action_values array<struct<action_type: string, value: string>>"""


def cents(text: Column) -> Column:
    return E.parse_money(text, F.lit("INR"))


def order_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, junk) of an export with a header; rows with a blank id or the ``######`` trailer are junk."""
    rows = csvsplit.rows(spark, path, CSV_COLUMNS)
    junk = F.coalesce(F.trim("ID"), F.lit("")).rlike("^(#+.*)?$")
    return rows.where(~junk), rows.where(junk)


def csv_orders(rows: DataFrame) -> DataFrame:
    """One row an order: the first value that is not blank of each order column, its lines and its refunds.

    Rows of an order may lie anywhere in the export; ``Row`` gives their order. Refund lines are told by their type.
    """
    told = lambda c: F.min_by(F.trim(c), F.when(F.trim(c) != "", F.col("Row")))
    item, back = F.col("Line: Type") == "Line Item", F.col("Line: Type") == "Refund Line"
    # Kept by order, so that counting distinct refunds needs no further shuffle.
    kept = bucketed(rows.withColumn("order_id", F.trim("ID").try_cast("long")).drop("ID"), "order_id", "csv")
    return kept.groupBy("order_id").agg(
        told("Name").alias("name"), told("Created At").alias("created_at"), told("Customer: ID").try_cast("long").alias("customer_id"),
        F.count_if(item).alias("lines"), F.coalesce(F.sum(F.when(item, F.col("Line: Quantity").try_cast("long"))), F.lit(0)).alias("units"),
        F.coalesce(F.sum(F.when(item, cents(F.col("Line: Total")))), F.lit(0)).alias("line_total"),
        F.count_distinct(F.when(back, F.col("Refund: ID"))).alias("refunds"), F.coalesce(F.sum(F.when(back, F.abs(cents(F.col("Line: Total"))))), F.lit(0)).alias("refund_total"),
    )


def gid_tail(gid: Column) -> Column:
    return F.element_at(F.split(gid, "/"), -1).try_cast("long")


def total(values: Column, of) -> Column:
    return F.aggregate(F.coalesce(values, F.array()), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(of(x), F.lit(0)))


def refund_amount(refund: Column) -> Column:
    """Sum of the successful refund transactions; without any, subtotals and taxes of the lines."""
    paid = F.filter(F.coalesce(refund["transactions"], F.array()), lambda t: (t["kind"] == "refund") & (t["status"] == "success"))
    return F.when(F.size(paid) > 0, total(paid, lambda t: F.abs(cents(t["amount"])))).otherwise(total(refund["lines"], lambda x: cents(x["subtotal"]) + cents(x["tax"])))


def store_orders(docs: DataFrame, column: str = "body") -> DataFrame:
    """One row a well-formed order document; others are dropped (count them with ``get_json_object`` on the input)."""
    o = docs.select(F.from_json(column, STORE_ORDER).alias("o")).select("o.*").where(gid_tail(F.col("id")).isNotNull())
    return o.select(
        gid_tail(F.col("id")).alias("order_id"), gid_tail(F.col("customer.id")).alias("customer_id"), F.col("createdAt").alias("created_at"),
        F.size(F.coalesce("lineItems", F.array())).cast("long").alias("lines"), total(F.col("lineItems"), lambda x: x["quantity"]).alias("units"),
        total(F.col("lineItems"), lambda x: cents(x["total"])).alias("line_total"), total(F.col("refunds"), refund_amount).alias("refund_total"),
    )


def leading_integer(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("0")), r"^\s*([+-]?\d+)", 1).try_cast("long")


def action(actions: str, kind: str) -> Column:
    """The first listed value of an action type, zero if it is not listed."""
    return F.coalesce(F.try_element_at(F.filter(F.col(actions), lambda a: a["action_type"] == kind), F.lit(1))["value"], F.lit("0"))


def window_tokens(setting: Column) -> Column:
    return F.regexp_extract_all(setting, F.lit(r"(\d+d_(?:click|view))"), 1)


def report_rows(docs: DataFrame, column: str = "body") -> DataFrame:
    """Daily ads rows of report documents; a row without an ad or a day is dropped."""
    r = docs.select(F.from_json(column, REPORT_ROW).alias("r")).select("r.*")
    r = r.where(F.col("ad_id").try_cast("long").isNotNull() & F.col("date_start").try_cast("date").isNotNull())
    return r.select(
        F.col("ad_id").try_cast("long").alias("ad_id"), F.col("date_start").try_cast("date").alias("day"), leading_integer(F.col("impressions")).alias("impressions"),
        leading_integer(F.col("clicks")).alias("clicks"), cents(F.col("spend")).alias("spend"), leading_integer(action("actions", "purchase")).alias("purchases"),
        cents(action("action_values", "purchase")).alias("purchase_value"), F.array_join(window_tokens(F.col("attribution_setting")), ",").alias("attribution"),
    )


def archive_parts(path: Column) -> list[Column]:
    """Source, day, resource, run and sequence of an archive path; null columns where the path has another form."""
    form = r"raw/([^/]+)/(\d{4})/(\d{2})/(\d{2})/(.+)_([^_/]+)_(\d+)\.json$"
    part = lambda i: F.when(path.rlike(form), F.regexp_extract(path, form, i))
    return [part(1).alias("source"), F.concat_ws("-", part(2), part(3), part(4)).try_cast("date").alias("day"), part(5).alias("resource"), part(6).alias("run"), part(7).cast("long").alias("seq")]
