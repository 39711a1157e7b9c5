"""Customer base: counts by place, distinct people, repeated records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradegrain.functions.names import row_count

def preview(df: DataFrame, key: str, rows: int = 5) -> DataFrame:
    """The first rows by key, all columns."""
    return df.orderBy(key).limit(rows)


def record_count(customers: DataFrame) -> DataFrame:
    return customers.agg(row_count().alias("total_customer_records"))


def _per_state(customers: DataFrame) -> DataFrame:
    return customers.groupBy("customer_state").agg(row_count().alias("total_customers"))


def by_state(customers: DataFrame) -> DataFrame:
    return _per_state(customers).orderBy(F.desc("total_customers"), "customer_state")


def by_state_fewest(customers: DataFrame) -> DataFrame:
    return _per_state(customers).orderBy("total_customers", "customer_state")


def top_states(customers: DataFrame, rows: int = 10) -> DataFrame:
    """Most frequent states; rows without a state do not count."""
    return by_state(customers.where(F.col("customer_state").isNotNull())).limit(rows)


def unique_customers(customers: DataFrame) -> DataFrame:
    return customers.agg(F.count_distinct("customer_unique_id").alias("unique_customers"))


def top_cities(customers: DataFrame, rows: int = 10) -> DataFrame:
    return (
        customers.groupBy("customer_city", "customer_state")
        .agg(row_count().alias("total_customers"))
        .orderBy(F.desc("total_customers"), "customer_city", "customer_state")
        .limit(rows)
    )


def _records_per_customer(customers: DataFrame) -> DataFrame:
    return customers.groupBy("customer_unique_id").agg(row_count().alias("records"))


def multiple_records(customers: DataFrame) -> DataFrame:
    return (
        _records_per_customer(customers)
        .where(F.col("records") > 1)
        .orderBy(F.desc("records"), "customer_unique_id")
    )


def multiple_record_count(customers: DataFrame) -> DataFrame:
    return _records_per_customer(customers).agg(
        F.count_if(F.col("records") > 1).alias("duplicate_customer_records")
    )


def city_count(customers: DataFrame) -> DataFrame:
    return customers.agg(F.count_distinct("customer_city").alias("total_cities"))


def cities_by_state(customers: DataFrame, name: str = "total_cities") -> DataFrame:
    return (
        customers.groupBy("customer_state")
        .agg(F.count_distinct("customer_city").alias(name))
        .orderBy(F.desc(name), "customer_state")
    )


def top_city_states(customers: DataFrame, rows: int = 10) -> DataFrame:
    return cities_by_state(customers, "number_of_cities").limit(rows)


def in_state(customers: DataFrame, state: str) -> DataFrame:
    return customers.where(F.col("customer_state") == state)


def record_frequency(customers: DataFrame) -> DataFrame:
    """How many people have one record, two records, and so on."""
    per_customer = (
        customers.where(F.col("customer_unique_id").isNotNull())
        .groupBy("customer_unique_id")
        .agg(F.count("customer_id").alias("records"))
    )
    return per_customer.groupBy("records").agg(row_count().alias("customers")).orderBy("records")
