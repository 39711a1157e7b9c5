"""Common table expressions for the SQL side: source tables and the order-grain master."""

from __future__ import annotations

import re

SECONDS = "(epoch_us({0}) - epoch_us({1}))"


def days(later: str, earlier: str) -> str:
    """Elapsed days as a double, through seconds."""
    return f"(((epoch_us({later}) - epoch_us({earlier})) / 1e6) / 86400.0)"


def up(expr: str, digits: int = 2) -> str:
    """Round half away from zero."""
    return f"(round(({expr}) * {10**digits}.0) / {10**digits}.0)"


def even(expr: str, digits: int = 2) -> str:
    """Round half to even."""
    return f"(round_even(({expr}) * {10**digits}.0, 0) / {10**digits}.0)"


def frac(top: str, bottom: str) -> str:
    """Double division, null on zero."""
    return f"(({top})::DOUBLE / nullif(({bottom})::DOUBLE, 0))"


def pct(top: str, bottom: str) -> str:
    return f"({frac(top, bottom)} * 100.0)"


def mean(expr: str) -> str:
    return frac(f"sum({expr})", f"count({expr})")


def mean_days(later: str, earlier: str, unit: float = 86400.0) -> str:
    """Average elapsed time from whole microseconds."""
    micros = f"(epoch_us({later}) - epoch_us({earlier}))"
    return f"((sum({micros})::DOUBLE / 1e6) / nullif(count({micros}), 0) / {unit})"


def clipped(expr: str, low: float, high: float) -> str:
    return f"(CASE WHEN ({expr}) IS NOT NULL THEN least(greatest(({expr})::DOUBLE, {low}), {high}) END)"


RELATIONS: dict[str, str] = {
    "b": """
        SELECT o_orderkey, o_custkey, o_orderdate, c_mktsegment, n_name,
               CASE WHEN o_orderstatus = 'F' THEN 'delivered'
                    WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 10 < 8 THEN 'delivered' ELSE 'shipped' END
                    ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'canceled' ELSE 'delivered' END END AS st,
               o_orderdate + (o_orderkey * 37 % 1440) * INTERVAL '1' MINUTE AS pts,
               2 + (o_orderkey * 7919 + o_custkey * 31) % 36 AS dd,
               12 + c_nationkey % 12 AS ed
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "p_customers": """
        SELECT o_orderkey AS customer_id, o_custkey * 16 + o_orderkey % 16 AS customer_unique_id,
               (o_custkey % 1000)::INT AS customer_zip_code_prefix,
               concat(lower(c_mktsegment), ' ', cast(o_custkey % 40 AS varchar)) AS customer_city,
               n_name AS customer_state
        FROM b""",
    "p_orders": """
        SELECT o_orderkey AS order_id, o_orderkey AS customer_id, st AS order_status,
               pts AS order_purchase_timestamp,
               CASE WHEN o_orderkey % 97 <> 0
                    THEN pts + (o_orderkey * 13 % 2880) * INTERVAL '1' MINUTE END AS order_approved_at,
               CASE WHEN st <> 'canceled'
                    THEN pts + (o_orderkey * 13 % 2880 + o_orderkey * 29 % 4320) * INTERVAL '1' MINUTE
                    END AS order_delivered_carrier_date,
               CASE WHEN st = 'delivered' AND o_orderkey % 211 <> 0
                    THEN pts + (dd * 1440 + o_orderkey * 53 % 1440) * INTERVAL '1' MINUTE
                    END AS order_delivered_customer_date,
               o_orderdate + (ed * 1440) * INTERVAL '1' MINUTE AS order_estimated_delivery_date
        FROM b""",
    "p_items": """
        SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
               l_suppkey AS seller_id,
               CAST(round(l_extendedprice) / 100 AS DECIMAL(18,2)) AS price,
               CAST(round(l_extendedprice * (l_tax + 0.05)) / 100 AS DECIMAL(18,2)) AS freight_value
        FROM lineitem""",
    "p_products": """
        SELECT p_partkey AS product_id,
               CASE WHEN p_partkey % 40 <> 0
                    THEN concat(lower(p_type), '_', replace(lower(p_brand), '#', '_')) END AS product_category_name,
               CASE WHEN p_partkey % 53 <> 0 THEN (p_size * 250)::DOUBLE END AS product_weight_g,
               (10 + p_size)::DOUBLE AS product_length_cm,
               (5 + p_size % 20)::DOUBLE AS product_height_cm,
               (8 + p_size % 30)::DOUBLE AS product_width_cm
        FROM part""",
    "p_translation": """
        SELECT DISTINCT product_category_name,
               replace(product_category_name, 'brand', 'line') AS product_category_name_english
        FROM p_products WHERE product_category_name NOT LIKE 'small%'""",
    "p_sellers": """
        SELECT s_suppkey AS seller_id, (s_suppkey % 1000)::INT AS seller_zip_code_prefix, n_name AS seller_state
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "p_payments": """
        SELECT l_orderkey AS order_id, l_linenumber AS payment_sequential,
               CASE WHEN l_returnflag = 'R' THEN 'credit_card' WHEN l_returnflag = 'A' THEN 'boleto'
                    WHEN l_linestatus = 'F' THEN 'voucher' ELSE 'debit_card' END AS payment_type,
               CASE WHEN l_returnflag = 'R' THEN 1 + CAST(l_quantity AS INT) % 10 ELSE 1 END AS payment_installments,
               CAST(round(l_extendedprice) / 100 AS DECIMAL(18,2)) AS payment_value
        FROM lineitem WHERE l_orderkey % 113 <> 0""",
    "p_reviews": """
        SELECT CASE WHEN o_orderkey % 499 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS review_id,
               CASE WHEN o_orderkey % 31 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS order_id,
               (CASE WHEN o_orderkey % 50 = 0 THEN NULL
                     WHEN dd <= ed - 3 THEN CASE WHEN o_orderkey % 17 = 0 THEN 1
                                                 WHEN o_orderkey % 3 = 0 THEN 4 ELSE 5 END
                     WHEN dd <= ed THEN 3 + o_orderkey % 3
                     WHEN dd <= ed + 3 THEN 1 + o_orderkey % 5
                     WHEN dd <= ed + 7 THEN 1 + o_orderkey % 3
                     ELSE CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END END)::INT AS review_score,
               COALESCE(text, CASE WHEN o_orderkey % 20 = 7 THEN '  ' END) AS review_comment_message,
               pts + ((dd + 1) * 1440) * INTERVAL '1' MINUTE AS review_creation_date
        FROM b LEFT JOIN documents ON doc_id = o_orderkey WHERE o_orderkey % 23 <> 0""",
    "p_geolocation": """
        SELECT (n_nationkey * 40)::INT AS geolocation_zip_code_prefix, lower(r_name) AS geolocation_city,
               n_name AS geolocation_state
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "catalog": """
        SELECT p.*, t.product_category_name_english,
               coalesce(t.product_category_name_english, p.product_category_name) AS category_english
        FROM p_products p LEFT JOIN p_translation t ON p.product_category_name = t.product_category_name""",
    "item_modes": """
        SELECT order_id, category_english FROM (
            SELECT order_id, category_english,
                   row_number() OVER (PARTITION BY order_id ORDER BY count(*) DESC, category_english) AS r
            FROM p_items JOIN catalog USING (product_id) WHERE category_english IS NOT NULL
            GROUP BY order_id, category_english)
        WHERE r = 1""",
    "item_agg": """
        SELECT i.order_id, arg_min(product_id, (order_item_id, product_id)) AS product_id,
               coalesce(any_value(m.category_english), 'Other') AS category_english,
               sum(price) AS price, sum(freight_value) AS freight_value, count(order_item_id) AS item_count
        FROM p_items i LEFT JOIN item_modes m USING (order_id) GROUP BY i.order_id""",
    "payment_modes": """
        SELECT order_id, payment_type FROM (
            SELECT order_id, payment_type,
                   row_number() OVER (PARTITION BY order_id ORDER BY count(*) DESC, payment_type) AS r
            FROM p_payments GROUP BY order_id, payment_type)
        WHERE r = 1""",
    "payment_agg": """
        SELECT p.order_id, any_value(m.payment_type) AS payment_type,
               max(payment_installments) AS payment_installments, sum(payment_value) AS payment_value
        FROM p_payments p LEFT JOIN payment_modes m USING (order_id) GROUP BY p.order_id""",
    "review_agg": "SELECT order_id, avg(review_score) AS review_score FROM p_reviews GROUP BY order_id",
    "joined": """
        SELECT o.*, c.* EXCLUDE (customer_id), i.* EXCLUDE (order_id),
               p.* EXCLUDE (order_id), r.review_score
        FROM p_orders o JOIN p_customers c USING (customer_id) JOIN item_agg i USING (order_id)
        LEFT JOIN payment_agg p USING (order_id) LEFT JOIN review_agg r USING (order_id)""",
    "lifetime": """
        SELECT customer_unique_id, count(DISTINCT order_id) AS customer_lifetime_orders
        FROM joined GROUP BY customer_unique_id""",
    "master": f"""
        SELECT j.*, year(order_purchase_timestamp)::INT AS order_year,
               month(order_purchase_timestamp)::INT AS order_month,
               strftime(order_purchase_timestamp, '%Y-%m') AS order_year_month,
               order_purchase_timestamp::DATE AS order_date,
               dayname(order_purchase_timestamp) AS day_of_week,
               {days('order_delivered_customer_date', 'order_purchase_timestamp')} AS delivery_days,
               {days('order_estimated_delivery_date', 'order_purchase_timestamp')} AS estimated_delivery_days,
               {days('order_delivered_customer_date', 'order_estimated_delivery_date')} AS delivery_delay_days,
               coalesce(order_delivered_customer_date > order_estimated_delivery_date, false) AS is_late,
               CASE WHEN order_delivered_customer_date > order_estimated_delivery_date
                    THEN 'Late' ELSE 'On-Time' END AS delivery_status,
               price + freight_value AS total_order_value,
               l.customer_lifetime_orders,
               coalesce(l.customer_lifetime_orders > 1, false) AS is_repeat_customer
        FROM joined j LEFT JOIN lifetime l USING (customer_unique_id)""",
    "delivered": "SELECT * FROM master WHERE order_status = 'delivered'",
    "filtered": """
        SELECT * FROM master
        WHERE order_date BETWEEN DATE '1997-01-01' AND DATE '2000-06-30'
          AND customer_state IN ('NATION_0', 'NATION_3', 'NATION_7', 'NATION_11', 'NATION_18')""",
    "filtered_delivered": "SELECT * FROM filtered WHERE order_status = 'delivered'",
    "native_modes": """
        SELECT order_id, product_category_name FROM (
            SELECT order_id, product_category_name,
                   row_number() OVER (PARTITION BY order_id ORDER BY count(*) DESC, product_category_name) AS r
            FROM p_items JOIN p_products USING (product_id) WHERE product_category_name IS NOT NULL
            GROUP BY order_id, product_category_name)
        WHERE r = 1""",
    "item_agg_native": """
        SELECT i.order_id, coalesce(any_value(m.product_category_name), 'Other') AS category_english,
               sum(price) AS price, sum(freight_value) AS freight_value
        FROM p_items i LEFT JOIN native_modes m USING (order_id) GROUP BY i.order_id""",
    "rfm_base": """
        SELECT customer_unique_id,
               floor((epoch_us((SELECT max(order_purchase_timestamp) FROM master) + INTERVAL '1' DAY)
                      - epoch_us(max(order_purchase_timestamp))) / 86400e6)::BIGINT AS recency,
               count(DISTINCT order_id) AS frequency, sum(total_order_value) AS monetary
        FROM master GROUP BY customer_unique_id""",
    "rfm_ranked": """
        SELECT *, count(*) OVER () AS n,
               row_number() OVER (ORDER BY recency, customer_unique_id) AS rr,
               row_number() OVER (ORDER BY monetary, customer_unique_id) AS mr
        FROM rfm_base""",
    "rfm_scored": """
        SELECT customer_unique_id, recency, frequency, monetary,
               (5 - greatest(1, (4 * (rr - 1) + n - 2) // (n - 1)))::INT AS R_score,
               greatest(1, (4 * (mr - 1) + n - 2) // (n - 1))::INT AS M_score,
               (CASE WHEN frequency >= 3 THEN 4 WHEN frequency = 2 THEN 3 ELSE 2 END)::INT AS F_score
        FROM rfm_ranked""",
    "rfm_labelled": """
        SELECT *, concat(R_score, F_score, M_score) AS RFM_Score,
               CASE WHEN F_score >= 3 AND R_score >= 3 AND M_score >= 3 THEN 'Champions'
                    WHEN F_score >= 3 AND R_score >= 2 THEN 'Loyal Customers'
                    WHEN F_score >= 3 THEN 'At Risk'
                    WHEN R_score >= 3 AND M_score >= 3 THEN 'Potential Loyalists'
                    WHEN R_score >= 3 THEN 'Recent Buyers'
                    WHEN M_score >= 3 THEN 'Cant Lose Them'
                    ELSE 'Hibernating' END AS Segment
        FROM rfm_scored""",
    "category_revenue": """
        SELECT category_english AS Category, sum(total_order_value) AS amount
        FROM master WHERE category_english IS NOT NULL GROUP BY category_english""",
    "pareto": f"""
        SELECT Category, amount::DOUBLE AS Revenue,
               (sum(amount) OVER w)::DOUBLE AS Cumulative_Revenue,
               {even('(sum(amount) OVER w)::DOUBLE / (sum(amount) OVER ())::DOUBLE * 100.0')} AS Cumulative_Pct,
               {even('amount::DOUBLE / (sum(amount) OVER ())::DOUBLE * 100.0')} AS Revenue_Share_Pct,
               {even('(sum(amount) OVER w)::DOUBLE / (sum(amount) OVER ())::DOUBLE * 100.0')} <= 80.0 AS Is_Top_80
        FROM category_revenue
        WINDOW w AS (ORDER BY amount DESC, Category ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "per_customer": """
        SELECT customer_unique_id, count(DISTINCT order_id) AS orders
        FROM p_orders LEFT JOIN p_customers USING (customer_id)
        WHERE customer_unique_id IS NOT NULL GROUP BY customer_unique_id""",
    "sales_months": """
        SELECT date_trunc('month', order_purchase_timestamp)::TIMESTAMP AS month, sum(price)::DOUBLE AS GMV,
               count(DISTINCT order_id) AS Orders,
               sum(price)::DOUBLE / count(DISTINCT order_id) AS Average_Order_Value
        FROM p_orders JOIN p_items USING (order_id) GROUP BY 1""",
    "first_order": """
        SELECT customer_unique_id, order_id, order_purchase_timestamp, order_delivered_customer_date,
               delivery_delay_days, customer_state, price, freight_value, payment_installments, review_score,
               customer_lifetime_orders
        FROM (SELECT *, row_number() OVER (PARTITION BY customer_unique_id
                                           ORDER BY order_purchase_timestamp, order_id) AS r FROM master)
        WHERE r = 1""",
    "repeat_features": f"""
        WITH s AS (SELECT *, {clipped('price', 10, 5000)} AS v, {clipped('freight_value', 1, 500)} AS f
                   FROM first_order)
        SELECT customer_unique_id, v AS first_order_value, f AS first_order_freight,
               {clipped('f / (v + f + 1e-5)', 0, 1)} AS freight_ratio,
               {clipped('coalesce(payment_installments, 1)', 1, 24)} AS payment_installments,
               {clipped('coalesce(review_score, 4.0)', 1, 5)} AS first_review_score,
               {clipped('coalesce(' + days('order_delivered_customer_date', 'order_purchase_timestamp') + ', 12.0)',
                        1, 60)} AS delivery_duration_days,
               {clipped('coalesce(delivery_delay_days, 0)', -20, 30)} AS delivery_delta_days,
               (customer_state IS DISTINCT FROM 'NATION_0')::INT AS is_interstate,
               (customer_lifetime_orders > 1)::INT AS is_repeat_customer
        FROM s""",
    "master_delay_features": f"""
        WITH s AS (SELECT *, {clipped('price', 10, 3000)} AS v, {clipped('freight_value', 5, 300)} AS f FROM delivered)
        SELECT order_id, v AS price, f AS freight_value, {clipped('f / (v + f + 1e-5)', 0, 1)} AS freight_ratio,
               1500.0::DOUBLE AS product_weight_g, 8000.0::DOUBLE AS product_volume_cm3,
               (customer_state IS DISTINCT FROM 'NATION_0')::INT AS is_interstate,
               {clipped('coalesce(estimated_delivery_days, 22.0)', 1, 90)} AS estimated_days,
               ((dayofweek(order_purchase_timestamp) + 6) % 7)::INT AS purchase_dayofweek,
               order_month AS purchase_month, is_late::INT AS is_delayed
        FROM s""",
    "item_figures": f"""
        SELECT order_id, sum(price)::DOUBLE AS price, sum(freight_value)::DOUBLE AS freight_value,
               arg_min(seller_id, (order_item_id, product_id, seller_id)) AS seller_id,
               {mean('product_weight_g')} AS w, {mean('product_length_cm')} AS l,
               {mean('product_height_cm')} AS h, {mean('product_width_cm')} AS d
        FROM p_items LEFT JOIN p_products USING (product_id) GROUP BY order_id""",
    "delay_features": f"""
        SELECT order_id, price, freight_value,
               {clipped('freight_value / (price + freight_value + 1e-5)', 0, 1)} AS freight_ratio,
               {clipped('coalesce(w, 1500.0)', 50, 30000)} AS product_weight_g,
               {clipped('coalesce(l, 25.0) * coalesce(h, 15.0) * coalesce(d, 20.0)', 100, 150000)} AS product_volume_cm3,
               coalesce(customer_state <> seller_state, true)::INT AS is_interstate,
               {clipped(days('order_estimated_delivery_date', 'order_purchase_timestamp'), 1, 90)} AS estimated_days,
               ((dayofweek(order_purchase_timestamp) + 6) % 7)::INT AS purchase_dayofweek,
               month(order_purchase_timestamp)::INT AS purchase_month,
               (order_delivered_customer_date > order_estimated_delivery_date)::INT AS is_delayed
        FROM p_orders JOIN item_figures USING (order_id) LEFT JOIN p_customers USING (customer_id)
        LEFT JOIN p_sellers USING (seller_id)
        WHERE order_status = 'delivered' AND order_delivered_customer_date IS NOT NULL
          AND order_estimated_delivery_date IS NOT NULL""",
    "csat_features": f"""
        WITH s AS (SELECT *, {clipped('price', 10, 3000)} AS v, {clipped('freight_value', 5, 300)} AS f,
                          {clipped('coalesce(delivery_delay_days, 0)', -20, 25)} AS delta
                   FROM master WHERE review_score IS NOT NULL)
        SELECT order_id, review_score, delta AS delivery_delta_days,
               {clipped('coalesce(delivery_days, 12.0)', 1, 60)} AS delivery_duration_days, v AS price,
               {clipped('f / (v + f + 1e-5)', 0, 1)} AS freight_ratio,
               {clipped('coalesce(payment_installments, 1)', 1, 24)} AS payment_installments,
               (delta > 0)::INT AS is_late, (customer_state IS DISTINCT FROM 'NATION_0')::INT AS is_interstate,
               (review_score <= 3)::INT AS is_low_csat
        FROM s""",
    "rule_scored": """
        SELECT order_id, is_low_csat AS label,
               least(1.0::DOUBLE, greatest(0.0::DOUBLE, (delivery_delta_days + 20.0) / 45.0)) AS score
        FROM csat_features""",
    "state_months": """
        SELECT customer_state, date_trunc('month', order_purchase_timestamp)::TIMESTAMP AS month,
               sum(total_order_value)::DOUBLE AS revenue, count(DISTINCT order_id) AS order_count
        FROM master
        WHERE order_purchase_timestamp >= TIMESTAMP '2000-01-01' AND order_purchase_timestamp < TIMESTAMP '2001-08-01'
        GROUP BY ALL""",
    "lines": """
        SELECT customer_state, list(revenue ORDER BY month) AS y, count(*) AS months, max(month) AS last_month
        FROM state_months GROUP BY customer_state""",
    "level_months": """
        SELECT CASE WHEN grouping(customer_state) = 0 THEN 'state:' || coalesce(customer_state, '')
                    WHEN grouping(category_english) = 0 THEN 'category:' || coalesce(category_english, '')
                    ELSE 'nation' END AS series,
               month, sum(total_order_value)::DOUBLE AS revenue, count(DISTINCT order_id) AS order_count
        FROM (SELECT *, date_trunc('month', order_purchase_timestamp)::TIMESTAMP AS month FROM master
              WHERE order_purchase_timestamp >= TIMESTAMP '2000-01-01' AND order_purchase_timestamp < TIMESTAMP '2001-08-01')
        GROUP BY GROUPING SETS ((month), (month, customer_state), (month, category_english))""",
    "level_lines": """
        SELECT series, list(revenue ORDER BY month) AS y, count(*) AS months, max(month) AS last_month
        FROM level_months GROUP BY series""",
}


def with_relations(statement: str) -> str:
    """Prefix a statement with the relations it names, directly or through other relations."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in RELATIONS.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(statement)
    parts = [f"{name} AS ({RELATIONS[name]})" for name in needed]
    body = statement.strip()
    keyword = "WITH"
    if body.upper().startswith("WITH RECURSIVE"):
        keyword, own = "WITH RECURSIVE", body[len("WITH RECURSIVE"):]
        return f"{keyword} " + ",\n".join([*parts, own.strip()])
    if body.upper().startswith("WITH "):
        return f"{keyword} " + ",\n".join([*parts, body[5:].strip()])
    return (f"WITH {', '.join(parts)}\n" if parts else "") + body
