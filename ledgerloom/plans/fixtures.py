"""Business tables projected from the driver tables.

Faults are placed by modulus of the record number, so every matching and
validation rule has rows that pass and rows that fail.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import MONEY
from ledgerloom.functions.identifiers import canonical_id, padded
from ledgerloom.operators import derive
from ledgerloom.operators.derive import id_number, same_number
from ledgerloom.session import dealt, has_shared_dir, staging_path


def every(number: Column | str, step: int, place: int = 0) -> Column:
    number = F.col(number) if isinstance(number, str) else number
    return number % step == place


def money(value: Column | str) -> Column:
    value = F.lit(value) if isinstance(value, str) else value
    return value.cast(MONEY)


# Derived tables that many queries read are written once per session and folder, as they
# would be stored in practice; short projections stay lazy.
STORED = ["orders", "payments", "fees", "refunds", "batches", "settlements",
          "settlement_payments", "bank_records", "invoices", "gst_records", "books", "raw_bank"]
_PATHS: dict[tuple[str, str, str], str] = {}


def spread(df: DataFrame) -> DataFrame:
    """Over all cores when a small input left fewer partitions than there are. Asking for the
    partitions runs all shuffles of a plan, so this is for plans without any."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread_files(spark: SparkSession, path: str, label: str) -> str:
    """Where the table lies in a file per core at least: a small one that was written in fewer
    is written again. Its plan runs once, as its partitions are not asked for beforehand."""
    cores = spark.sparkContext.defaultParallelism
    table = spark.read.parquet(path)
    if len(table.inputFiles()) >= cores:
        return path
    again = staging_path(spark, label)
    table.repartition(cores).write.parquet(again)
    return again


class Fixtures:
    """Business tables over one folder of driver tables."""

    def __init__(self, spark: SparkSession, folder: str):
        # Timestamps of the driver tables are UTC wall times.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.folder = folder
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or not hasattr(type(self), f"_build_{name}"):
            raise AttributeError(name)
        if name not in self._frames:
            self._frames[name] = self._stored(name) if name in STORED else self.build(name)
        return self._frames[name]

    def build(self, name: str) -> DataFrame:
        """The table as a plan over its inputs."""
        return getattr(self, f"_build_{name}")()

    def _stored(self, name: str) -> DataFrame:
        return self.stored(name, lambda: self.build(name))

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A frame written once per session and folder, where a shared folder is known."""
        if not has_shared_dir(self.spark):
            return build()
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _PATHS:
            path = staging_path(self.spark, name)
            build().write.parquet(path)
            _PATHS[key] = spread_files(self.spark, path, name)
        return self.spark.read.parquet(_PATHS[key])

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def all(self) -> dict[str, DataFrame]:
        names = ["merchants", "customers", "orders", "invoices", "gst_records", "payments",
                 "fees", "refunds", "settlements", "settlement_payments", "bank_records",
                 "books", "adjustments"]
        return {name: getattr(self, name) for name in names}

    def _merchant_total(self) -> Column:
        return self.raw("supplier").agg(F.count(F.lit(1))).scalar()

    def _build_merchants(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.raw("supplier").select(
            padded("MER", key + 1).alias("merchant_id"),
            F.col("s_name").alias("merchant_name"),
            F.concat(F.lit("27AABC"), F.lpad(key.cast("string"), 7, "0"), F.lit("Z1"))
            .alias("gstin"),
            F.concat(F.lit("ST"), (F.col("s_nationkey") % 3).cast("string")).alias("state"),
            F.lit("INR").alias("currency"), F.lit("ACTIVE").alias("status"),
        )

    def _build_customers(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            padded("CUS", key + 1).alias("customer_id"),
            padded("MER", key % self._merchant_total() + 1).alias("merchant_id"),
            F.col("c_name").alias("name"),
            F.concat(F.lit("c"), key.cast("string"), F.lit("@example.com")).alias("email"),
            F.concat(F.lit("ST"), (F.col("c_nationkey") % 3).cast("string")).alias("state"),
        )

    def _build_orders(self) -> DataFrame:
        status = (F.when(F.col("o_orderstatus") == "F", "COMPLETED")
                  .when(F.col("o_orderstatus") == "O", "PENDING").otherwise("CANCELLED"))
        base = self.raw("orders").select(
            padded("ORD", F.col("o_orderkey") + 1).alias("order_id"),
            padded("CUS", F.col("o_custkey") + 1).alias("customer_id"),
            F.col("o_orderdate").cast("timestamp").alias("order_date"),
            money(F.col("o_totalprice")).alias("total_amount"),
            status.alias("status"),
        )
        buyers = self.customers.select("customer_id", "merchant_id",
                                       F.col("state").alias("buyer_state"))
        sellers = self.merchants.select("merchant_id", F.col("state").alias("seller_state"))
        taxable = money(F.round(F.col("total_amount").cast("double") / 1.18, 2))
        taxed = (
            base.join(dealt(buyers), "customer_id").join(dealt(sellers), "merchant_id")
            .withColumn("taxable_amount", taxable)
            .withColumn("total_tax", money(F.col("total_amount") - F.col("taxable_amount")))
        )
        cents = F.round(F.col("total_tax").cast("double") * 100).cast("bigint")
        half = money((cents - cents % 2).cast("double") / 200)
        local = F.col("seller_state") == F.col("buyer_state")
        return taxed.select(
            "order_id", "merchant_id", "customer_id", "order_date",
            F.col("taxable_amount").alias("subtotal"), money("0").alias("discount"),
            "taxable_amount",
            F.when(local, half).otherwise(money("0")).alias("cgst"),
            F.when(local, money(F.col("total_tax") - half)).otherwise(money("0")).alias("sgst"),
            F.when(local, money("0")).otherwise(F.col("total_tax")).alias("igst"),
            "total_tax", "total_amount", F.lit("INR").alias("currency"), "status",
            "seller_state", "buyer_state",
        )

    def _build_payments(self) -> DataFrame:
        n = id_number("order_id")
        method = (F.when(every(n, 4), "UPI").when(every(n, 4, 1), "CARD")
                  .when(every(n, 4, 2), "NETBANKING").otherwise("WALLET"))
        state = (F.when(every(n, 11), "FAILED").when(every(n, 13), "PENDING")
                 .otherwise("CAPTURED"))
        later = F.make_dt_interval(n % 3, F.lit(0), F.lit(0), n % 86400)
        return self.orders.filter(~every(n, 53)).select(
            same_number("PAY", "order_id").alias("payment_id"),
            F.when(every(n, 101), padded("ORD", n + 900000000)).otherwise(F.col("order_id"))
            .alias("order_id"),
            "merchant_id", "customer_id",
            F.when(every(n, 97), money(F.col("total_amount") + money("1.50")))
            .otherwise(F.col("total_amount")).alias("amount"),
            "currency", method.alias("payment_method"), state.alias("status"),
            F.lit("gateway").alias("gateway"),
            F.concat(F.lit("pay_"), F.when(every(n, 61), n - 1).otherwise(n).cast("string"))
            .alias("gateway_reference"),
            (F.col("order_date") + later).alias("payment_date"),
        )

    def _build_fees(self) -> DataFrame:
        return derive.derive_fees(self.payments).filter(~every(id_number("payment_id"), 71))

    def _build_refunds(self) -> DataFrame:
        n = id_number("payment_id")
        amount = F.col("amount")
        kind = F.when(every(n, 3), "FULL").otherwise("PARTIAL")
        back = F.when(every(n, 3), amount).otherwise(
            money(F.round(amount * F.lit("0.5").cast("decimal(5,4)"), 2)))
        chosen = self.payments.filter((F.col("status") == "CAPTURED") & every(n, 17))
        return chosen.select(
            same_number("REF", "payment_id").alias("refund_id"), "payment_id", "order_id",
            "merchant_id",
            F.when(every(n, 5), money(back + money("10.00"))).otherwise(back)
            .alias("refund_amount"),
            kind.alias("refund_type"), F.lit("PROCESSED").alias("status"),
            (F.col("payment_date") + F.make_dt_interval(F.lit(4))).alias("refund_date"),
            "currency",
        )

    def _build_batches(self) -> DataFrame:
        return derive.assign_batches(self.payments)

    def _build_settlements(self) -> DataFrame:
        n = id_number("settlement_id")
        built = derive.derive_settlements(self.batches, self.fees, self.refunds)
        return built.withColumn("net_amount", F.when(
            every(n, 37), money(F.col("net_amount") + money("1.00")))
            .otherwise(F.col("net_amount")))

    def _build_settlement_payments(self) -> DataFrame:
        n = id_number("payment_id")
        links = derive.derive_links(self.batches)
        return links.withColumn("allocated_amount", F.when(
            every(n, 83), F.lit(None).cast(MONEY)).when(
            every(n, 89), money(F.col("allocated_amount") - money("0.75")))
            .otherwise(F.col("allocated_amount")))

    def _build_bank_records(self) -> DataFrame:
        n = id_number("settlement_id")
        day = F.to_date("settlement_date")
        tail = F.length("utr")
        reference = (
            F.when(every(n, 13, 5), F.lit(None).cast("string"))
            .when(every(n, 7), F.concat(F.lower(F.substring("utr", 1, 4)), F.lit("-"),
                                        F.expr("substring(utr, 5)")))
            .when(every(n, 11, 3), F.concat(F.expr("substring(utr, 1, length(utr) - 2)"),
                                            F.lit("X"), F.substring("utr", -1, 1)))
            .otherwise(F.col("utr"))
        )
        when = (F.when(every(n, 29, 2), F.lit(None).cast("date"))
                .when(every(n, 31, 3), F.date_add(day, 40))
                .otherwise(F.date_add(day, (n % 3).cast("int"))))
        received = self.settlements.filter(~every(n, 17)).select(
            padded("BNK", n).alias("bank_record_id"), "merchant_id",
            when.alias("transaction_date"), when.alias("value_date"),
            F.when(every(n, 19, 4), money(F.col("net_amount") + money("25.00")))
            .otherwise(F.col("net_amount")).alias("amount"),
            "currency", F.lit("CREDIT").alias("transaction_type"),
            reference.alias("reference"),
            F.concat(F.lit("NEFT SETTLEMENT "), F.col("settlement_id")).alias("description"),
            F.when(~every(n, 23, 1), F.col("settlement_id")).alias("settlement_id"),
            F.lit("SETTLEMENT").alias("category"),
        )
        other = self.settlements.filter(every(n, 5)).select(
            padded("BNK", n + 500000000000).alias("bank_record_id"), "merchant_id",
            F.date_add(day, 1).alias("transaction_date"), F.date_add(day, 1).alias("value_date"),
            money(F.round(F.col("net_amount") * F.lit("0.25").cast("decimal(5,4)"), 2))
            .alias("amount"),
            "currency",
            F.when(every(n, 2), "DEBIT").otherwise("CREDIT").alias("transaction_type"),
            F.concat(F.lit("REF"), n.cast("string")).alias("reference"),
            F.lit("BANK CHARGES").alias("description"),
            F.lit(None).cast("string").alias("settlement_id"),
            F.when(every(n, 3), F.lit(None).cast("string")).otherwise("CHARGES")
            .alias("category"),
        )
        return received.unionByName(other)

    def _build_adjustments(self) -> DataFrame:
        n = id_number("settlement_id")
        kind = (F.when(every(n, 24), "CHARGEBACK").when(every(n, 36), "ROUNDING")
                .otherwise("MANUAL_ADJUSTMENT"))
        return self.settlements.filter(every(n, 12)).select(
            same_number("ADJ", "settlement_id").alias("adjustment_id"),
            F.when(every(n, 48), padded("STL", n + 900000000000)).otherwise(
                F.col("settlement_id")).alias("settlement_id"),
            "merchant_id", kind.alias("adjustment_type"),
            F.when(every(n, 24), money("-40.00")).otherwise(money("1.00")).alias("amount"),
            F.when(every(n, 24), "DEBIT").otherwise("CREDIT").alias("direction"),
            (F.col("settlement_date") + F.make_dt_interval(F.lit(1))).alias("adjustment_date"),
            "currency", F.lit("APPLIED").alias("status"),
        )

    def _build_invoices(self) -> DataFrame:
        n = id_number("order_id")
        made = derive.derive_invoices(self.orders, self.merchants).filter(~every(n, 43))
        return made.withColumn("total_amount", F.when(
            every(n, 47), money(F.col("total_amount") + money("0.50")))
            .otherwise(F.col("total_amount")))

    def _build_gst_records(self) -> DataFrame:
        n = id_number("invoice_id")
        made = derive.derive_gst(self.invoices).filter(~every(n, 59))
        return made.withColumn("total_tax", F.when(
            every(n, 31), money(F.col("total_tax") + money("0.10")))
            .otherwise(F.col("total_tax")))

    def _build_books(self) -> DataFrame:
        n = id_number("reference_id")
        second = every(id_number("entry_id"), 10, 2)
        made = derive.derive_books(self.orders, self.payments, self.fees, self.refunds,
                                   self.settlements, self.adjustments)
        kept = made.filter(~(every(n, 41) & second))
        loose = F.when(every(n, 19), F.regexp_replace("reference_id", "_", "-")).otherwise(
            F.col("reference_id"))
        return kept.withColumn("canonical_reference_id", canonical_id("reference_id")).withColumn(
            "reference_id", loose)

    def _build_raw_bank(self) -> DataFrame:
        """Untyped bank feed with mixed spellings, one row per event."""
        n = F.col("event_id")
        digits = F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), F.lit(6)),
                        F.lit("0"))
        amount = money(F.round(F.col("value"), 2)).cast("string")
        t = F.col("ts").cast("timestamp")
        iso = F.date_format(t, "yyyy-MM-dd")
        clock = F.date_format(t, "HH:mm:ss")
        day, month, year = (F.date_format(t, p) for p in ("dd", "MM", "yyyy"))

        def turn(step: int, *choices) -> Column:
            picked = F.when(every(n, step, 0), choices[0])
            for place, choice in enumerate(choices[1:], 1):
                picked = picked.when(every(n, step, place), choice)
            return picked

        def cat(*parts) -> Column:
            return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

        nothing = F.lit(None).cast("string")
        return self.raw("events").select(
            (n + 1).alias("row_number"),
            turn(8, cat("BNK_", digits), cat("BNK-", digits), cat("bnk/", digits),
                 cat("BANK", digits), cat("b_", digits), cat("BNK_", digits),
                 cat(" BNK", digits, " "), cat("bank-", digits)).alias("bank_record_id"),
            F.when(every(n, 67), cat("XX-", digits)).when(every(n, 71), nothing)
            .otherwise(padded("MER", F.col("user_id") % 50 + 1)).alias("merchant_id"),
            turn(9, amount, cat("₹", amount), cat("Rs. ", amount), cat("INR ", amount),
                 cat("$", amount), cat("usd ", amount), cat("-", amount),
                 F.when(every(n, 4), cat(amount, "O")).otherwise(amount),
                 F.when(every(n, 5), F.lit("n/a")).otherwise(cat("1,", amount))).alias("amount"),
            turn(8, iso, cat(day, "/", month, "/", year), cat(day, "-", month, "-", year),
                 cat(iso, "T", clock, "+05:30"), cat(iso, " ", clock), cat(iso, "T", clock),
                 F.when(every(n, 3), F.lit("not a date")).otherwise(iso),
                 cat(iso, "T", clock, "+00:00")).alias("transaction_date"),
            turn(7, F.lit("INR"), F.lit("inr"), F.lit("Rs."), F.lit("usd"), F.lit("₹"),
                 F.lit(""), F.lit("doge")).alias("currency"),
            turn(5, F.lit("credit"), F.lit("CREDIT"), F.lit("debit"), F.lit("Credit"),
                 F.lit("refund")).alias("transaction_type"),
            F.when(every(n, 6), nothing).otherwise(
                cat("utib ", (n % 4000).cast("string"))).alias("reference"),
            turn(4, cat("NEFT-CR ", F.col("event_type")), cat("upi/", F.col("event_type"), "/x"),
                 cat("  Card, ", F.col("event_type"), "; fee "), F.col("event_type"))
            .alias("description"),
            F.concat(F.lit("feed_"), (n % 4).cast("string"), F.lit(".jsonl")).alias("file"),
        )
