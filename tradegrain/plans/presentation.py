"""Tables as readers see them: formatted text columns under display names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradegrain.functions.text import fixed_point, plain_reais, reais, thousands


def _present(df: DataFrame, formats: dict[str, Column], names: dict[str, str]) -> DataFrame:
    return df.withColumns(formats).withColumnsRenamed(names)


def segments(table: DataFrame) -> DataFrame:
    formats = {
        "Customer_Count": thousands(F.col("Customer_Count")),
        "Customer_Pct": fixed_point(F.col("Customer_Pct"), 1, "%"),
        "Total_Revenue": reais(F.col("Total_Revenue")),
        "Revenue_Pct": fixed_point(F.col("Revenue_Pct"), 1, "%"),
        "Avg_Spend": reais(F.col("Avg_Spend")),
        "Avg_Recency": fixed_point(F.col("Avg_Recency"), 0, " days"),
    }
    # Display names.
    names = {
        "Customer_Count": "Customers",
        "Customer_Pct": "% Customers",
        "Total_Revenue": "Total Spend",
        "Revenue_Pct": "% Revenue",
        "Avg_Spend": "Avg Customer Spend",
        "Avg_Recency": "Avg Recency",
        "Strategic_Action": "Strategic Playbook",
    }
    return _present(table, formats, names)


def pareto(table: DataFrame) -> DataFrame:
    formats = {
        "Revenue": reais(F.col("Revenue")),
        "Revenue_Share_Pct": fixed_point(F.col("Revenue_Share_Pct"), 1, "%"),
        "Cumulative_Pct": fixed_point(F.col("Cumulative_Pct"), 1, "%"),
    }
    # Display names.
    names = {
        "Category": "Product Category",
        "Revenue": "Gross Revenue",
        "Revenue_Share_Pct": "Share of GMV",
        "Cumulative_Pct": "Cumulative Share",
        "Is_Top_80": "Top 80% Contributor",
    }
    return _present(table, formats, names)


def state_logistics(table: DataFrame) -> DataFrame:
    formats = {
        "Total_Orders": thousands(F.col("Total_Orders")),
        "Total_Revenue": reais(F.col("Total_Revenue")),
        "Avg_Delivery_Days": fixed_point(F.col("Avg_Delivery_Days"), 1, " days"),
        "Late_Delivery_Pct": fixed_point(F.col("Late_Delivery_Pct"), 1, "%"),
        "Avg_Freight_Cost": plain_reais(F.col("Avg_Freight_Cost")),
        "Avg_Review_Score": fixed_point(F.col("Avg_Review_Score"), 2, " ⭐"),
    }
    # Display names.
    names = {
        "customer_state": "State",
        "Total_Orders": "Delivered Orders",
        "Total_Revenue": "Gross Revenue",
        "Avg_Delivery_Days": "Avg Delivery Time",
        "Late_Delivery_Pct": "Late Delivery Rate",
        "Avg_Freight_Cost": "Avg Freight",
        "Avg_Review_Score": "Avg Review Score",
    }
    return _present(table, formats, names)


def payment_channels(table: DataFrame) -> DataFrame:
    formats = {
        "Orders": thousands(F.col("Orders")),
        "Total_Spend": reais(F.col("Total_Spend")),
        "Avg_Ticket": reais(F.col("Avg_Ticket")),
        "Avg_Installments": fixed_point(F.col("Avg_Installments"), 1, "x"),
    }
    # Display names.
    names = {
        "payment_type": "Payment Method",
        "Orders": "Transaction Volume",
        "Total_Spend": "Gross Payment Volume",
        "Avg_Ticket": "Average Order Value (AOV)",
        "Avg_Installments": "Average Installments",
    }
    return _present(table, formats, names)


def forecast(table: DataFrame, by: list[str]) -> DataFrame:
    # Display names.
    names = {
        "forecast": "Forecast GMV",
        "ci_80_lower": "80% CI Lower",
        "ci_80_upper": "80% CI Upper",
        "ci_95_lower": "95% CI Lower",
        "ci_95_upper": "95% CI Upper",
    }
    shown = [reais(F.col(c)).alias(name) for c, name in names.items()]
    return table.select(*by, F.col("ds").alias("Forecast Month"), *shown)
