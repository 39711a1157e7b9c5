"""One SQL statement per registered query, over the relations of :mod:`checks.relations`."""

from __future__ import annotations

import re

from checks.relations import days, even, frac, mean, mean_days, pct, up

ORACLES: dict[str, str] = {}
LATE = "order_delivered_customer_date > order_estimated_delivery_date"
LATE_DAYS = "extract(day FROM order_delivered_customer_date - order_estimated_delivery_date)"
FILLED = "trim(coalesce(review_comment_message, '')) <> ''"
TRANSIT = mean_days("order_delivered_customer_date", "order_purchase_timestamp")


def add(**statements: str) -> None:
    ORACLES.update(statements)


def rows_where(flag: str) -> str:
    """Percentage of all rows where a flag holds; null does not hold."""
    return pct(f"count(*) FILTER (WHERE {flag})", "count(*)")


# --- sources, derived columns, joins, filters --------------------------------------------------

DATES = [
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
]
add(
    src_csv_orders="SELECT * FROM p_orders",
    src_csv_reviews="SELECT * FROM p_reviews",
    src_coerce_ts="SELECT order_id, "
    + ", ".join(f"CASE WHEN order_id % 10 <> 0 THEN {c} END AS {c}" for c in DATES)
    + " FROM p_orders",
    src_optional_defaults="""
        SELECT order_id, category_english, 'credit_card' AS payment_type, 1 AS payment_installments,
               (price + freight_value)::DOUBLE AS payment_value, 4.0::DOUBLE AS review_score
        FROM p_orders JOIN p_customers USING (customer_id) JOIN item_agg_native USING (order_id)
    """,
    master_orders="""
        SELECT order_id, customer_id, customer_unique_id, customer_city, customer_state, order_status,
               order_purchase_timestamp, order_approved_at, order_delivered_carrier_date,
               order_delivered_customer_date, order_estimated_delivery_date, customer_zip_code_prefix,
               product_id, category_english, price::DOUBLE AS price,
               freight_value::DOUBLE AS freight_value, item_count, payment_type, payment_installments,
               payment_value::DOUBLE AS payment_value, review_score, order_year, order_month,
               order_year_month, order_date, day_of_week, delivery_days, estimated_delivery_days,
               delivery_delay_days, is_late, delivery_status, total_order_value::DOUBLE AS total_order_value,
               is_repeat_customer, customer_lifetime_orders
        FROM master""",
    prj_time_parts="SELECT order_id, order_year, order_month, order_year_month, order_date, day_of_week FROM master",
    prj_delivery_days="SELECT order_id, delivery_days, estimated_delivery_days, delivery_delay_days FROM master",
    prj_delivery_status="SELECT order_id, is_late, delivery_status FROM master",
    prj_total_value="SELECT order_id, total_order_value::DOUBLE AS total_order_value FROM master",
    prj_lifetime_orders="""
        SELECT order_id, customer_unique_id, customer_lifetime_orders, is_repeat_customer FROM master""",
    prj_category_title="""
        SELECT product_id, product_category_name,
               coalesce((SELECT string_agg(upper(w[1]) || lower(w[2:]), ' ')
                         FROM (SELECT unnest(string_split(product_category_name, '_')) AS w)), 'Other')
               AS category_english
        FROM p_products""",
    prj_head5="SELECT * FROM p_customers ORDER BY customer_id LIMIT 5",
    jn_orders_customers="""
        SELECT order_id, customer_id, customer_unique_id, customer_state, order_status
        FROM p_orders JOIN p_customers USING (customer_id)""",
    jn_category_translation="SELECT product_id, product_category_name, category_english FROM catalog",
    jn_items_products="""
        SELECT order_id, order_item_id, product_id, category_english, price::DOUBLE AS price,
               freight_value::DOUBLE AS freight_value
        FROM p_items LEFT JOIN catalog USING (product_id)""",
    ag_items_per_order="""
        SELECT order_id, product_id, category_english, price::DOUBLE AS price,
               freight_value::DOUBLE AS freight_value, item_count FROM item_agg""",
    ag_payments_per_order="""
        SELECT order_id, payment_type, payment_installments, payment_value::DOUBLE AS payment_value
        FROM payment_agg""",
    ag_reviews_per_order="SELECT * FROM review_agg",
    fil_dashboard="""
        SELECT order_id, order_date, customer_state, category_english,
               total_order_value::DOUBLE AS total_order_value FROM filtered""",
    fil_domain="""
        SELECT 'first_date' AS kind, min(order_date)::VARCHAR AS choice FROM master
        UNION ALL SELECT 'last_date', max(order_date)::VARCHAR FROM master
        UNION ALL SELECT DISTINCT 'state', customer_state FROM master
        UNION ALL SELECT DISTINCT 'category', category_english FROM master""",
)

# --- headline figures, segments, concentration, logistics, payments ----------------------------

REPEATS = """
    SELECT count(*) AS unique_customers, count(*) FILTER (WHERE n > 1) AS repeat_customers,
           count(*) FILTER (WHERE n = 1) AS one_time_customers
    FROM (SELECT customer_unique_id, count(DISTINCT order_id) AS n FROM delivered GROUP BY 1)
"""
GROWTH = """
    SELECT coalesce((cur - prev) / prev * 100.0, 0.0) AS mom_growth FROM (
        SELECT m, v AS cur, lag(v) OVER (ORDER BY m) AS prev FROM (
            SELECT order_year_month AS m, sum(total_order_value)::DOUBLE AS v FROM delivered GROUP BY 1))
    ORDER BY m DESC LIMIT 1
"""
SEGMENTS = f"""
    SELECT Segment, count(*) AS Customer_Count, {even(mean('recency'), 0)} AS Avg_Recency,
           {mean('frequency')} AS Avg_Frequency, {even(mean('monetary'))} AS Avg_Spend,
           {even('sum(monetary)::DOUBLE')} AS Total_Revenue,
           {even(pct('count(*)', 'sum(count(*)) OVER ()'), 1)} AS Customer_Pct,
           {even(pct('sum(monetary)', 'sum(sum(monetary)) OVER ()'), 1)} AS Revenue_Pct,
           CASE Segment
               WHEN 'Champions' THEN 'VIP loyalty perks, early access to new lines, ambassador referrals.'
               WHEN 'Loyal Customers' THEN 'Upsell premium bundles, personalized category recommendations.'
               WHEN 'Potential Loyalists' THEN 'Offer membership incentives, engage with post-purchase rewards.'
               WHEN 'Recent Buyers' THEN
                   'Provide high-touch onboarding, trigger second-purchase discount in 14 days.'
               WHEN 'At Risk' THEN 'Aggressive win-back campaigns, limited-time renewal coupons, feedback survey.'
               WHEN 'Cant Lose Them' THEN
                   'Direct outreach, premium concierge support, high-value retention voucher.'
               WHEN 'Hibernating' THEN 'Low-cost email drip re-engagement campaigns, seasonal flash clearance.'
               END AS Strategic_Action
    FROM rfm_labelled GROUP BY Segment
"""
DELAY_CASE = """
    CASE WHEN delivery_delay_days <= -3 THEN {0!r} WHEN delivery_delay_days <= 0 THEN {1!r}
         WHEN delivery_delay_days <= 3 THEN {2!r} WHEN delivery_delay_days <= 7 THEN {3!r} ELSE {4!r} END
"""
BUCKETS = [
    "Early (>3 days)",
    "On-Time (0-3 days early)",
    "Slight Delay (1-3 days late)",
    "Moderate Delay (4-7 days late)",
    "Severe Delay (>7 days late)",
]
TIERS = [
    "1. Early (> 3 Days)",
    "2. On-Time (0-3 Days Early)",
    "3. Minor Delay (1-3 Days Late)",
    "4. Moderate Delay (4-7 Days Late)",
    "5. Severe Delay (> 7 Days Late)",
]
BY_STATE = f"""
    SELECT customer_state, count(DISTINCT order_id) AS Total_Orders,
           {even('sum(total_order_value)::DOUBLE')} AS Total_Revenue, {even(TRANSIT, 1)} AS Avg_Delivery_Days,
           {even(rows_where('is_late'), 1)} AS Late_Delivery_Pct,
           {even(mean('freight_value'))} AS Avg_Freight_Cost, {even(mean('review_score'))} AS Avg_Review_Score
    FROM master WHERE delivery_delay_days IS NOT NULL AND review_score IS NOT NULL GROUP BY customer_state
"""
CHANNELS = f"""
    SELECT payment_type, count(DISTINCT order_id) AS Orders, sum(total_order_value)::DOUBLE AS Total_Spend,
           {mean('total_order_value')} AS Avg_Ticket, {mean('payment_installments')} AS Avg_Installments
    FROM master WHERE payment_type IS NOT NULL GROUP BY payment_type
"""
TOP_STATES = f"""
    SELECT customer_state, sum(total_order_value)::DOUBLE AS Revenue, count(DISTINCT order_id) AS Orders,
           {mean('freight_value')} AS Avg_Freight
    FROM master GROUP BY customer_state ORDER BY Revenue DESC, customer_state LIMIT 10
"""
add(
    kpi_overview=f"""
        WITH figures AS (
            SELECT sum(total_order_value)::DOUBLE AS total_revenue, sum(price)::DOUBLE AS product_revenue,
                   sum(freight_value)::DOUBLE AS freight_revenue, count(DISTINCT order_id) AS total_orders,
                   {mean('review_score')} AS avg_review, {TRANSIT} AS avg_delivery_days,
                   count(DISTINCT order_id) FILTER (WHERE is_late) AS late
            FROM delivered),
        buyers AS ({REPEATS}), growth AS ({GROWTH})
        SELECT total_revenue, product_revenue, freight_revenue, total_orders, unique_customers,
               repeat_customers, one_time_customers, total_revenue / total_orders AS aov, avg_review,
               avg_delivery_days, 100.0 - {pct('late', 'total_orders')} AS ontime_rate,
               {pct('late', 'total_orders')} AS late_rate,
               {pct('repeat_customers', 'unique_customers')} AS repeat_rate, mom_growth
        FROM figures, buyers, growth""",
    kpi_repeat=REPEATS,
    kpi_mom_latest=GROWTH,
    rfm_base="SELECT customer_unique_id, recency, frequency, monetary::DOUBLE AS monetary FROM rfm_base",
    rfm_scores="SELECT customer_unique_id, R_score, F_score, M_score, RFM_Score FROM rfm_labelled",
    rfm_customers="SELECT customer_unique_id, RFM_Score, Segment FROM rfm_labelled",
    rfm_segments=SEGMENTS,
    pareto_categories="SELECT * FROM pareto",
    pareto_summary=f"""
        SELECT count(*) FILTER (WHERE Is_Top_80) AS top_80_categories, count(*) AS total_categories,
               {rows_where('Is_Top_80')} AS top_80_pct,
               count(*) - count(*) FILTER (WHERE Is_Top_80) AS tail_categories,
               arg_min(Category, Cumulative_Revenue) AS top_category, max(Revenue) AS top_category_revenue
        FROM pareto""",
    viz_pareto20="SELECT * FROM pareto ORDER BY Revenue DESC, Category LIMIT 20",
    csat_delay_buckets=f"""
        SELECT Delay_Bucket, Order_Count, Avg_Review_Score, Pct_1_Star, Pct_5_Star
        FROM (VALUES {', '.join(f'({label!r})' for label in BUCKETS)}) AS k(Delay_Bucket) LEFT JOIN (
            SELECT {DELAY_CASE.format(*BUCKETS)} AS Delay_Bucket, count(DISTINCT order_id) AS Order_Count,
                   {even(mean('review_score'))} AS Avg_Review_Score,
                   {even(rows_where('review_score = 1'), 1)} AS Pct_1_Star,
                   {even(rows_where('review_score = 5'), 1)} AS Pct_5_Star
            FROM master WHERE delivery_delay_days IS NOT NULL AND review_score IS NOT NULL GROUP BY 1)
        USING (Delay_Bucket)""",
    logistics_by_state=BY_STATE,
    payment_channels=CHANNELS,
    viz_payment_share="""
        SELECT payment_type, sum(total_order_value)::DOUBLE AS total_order_value
        FROM master WHERE payment_type IS NOT NULL GROUP BY payment_type""",
    viz_installments=f"""
        WITH shown AS (
            SELECT k::INT AS Installments, count(order_id) AS "Count"
            FROM range(1, 11) AS t(k)
            LEFT JOIN master ON payment_type = 'credit_card' AND coalesce(payment_installments, 1) = k
            GROUP BY k)
        SELECT Installments, "Count", concat(Installments, 'x') AS "Label",
               {even(pct('"Count"', 'greatest(1, sum("Count") OVER ())'), 1)} AS Pct FROM shown""",
    viz_monthly="""
        SELECT order_year_month, sum(total_order_value)::DOUBLE AS Revenue, count(DISTINCT order_id) AS Orders
        FROM master GROUP BY order_year_month""",
    viz_top_states=TOP_STATES,
    viz_rfm_scatter="""
        SELECT customer_unique_id, recency, frequency, monetary::DOUBLE AS monetary, Segment FROM rfm_labelled
        ORDER BY md5(concat(customer_unique_id, ':42')), customer_unique_id LIMIT 2000""",
    fmt_segments=f"""
        SELECT Segment, format('{{:,}}', Customer_Count) AS "Customers",
               printf('%.0f days', Avg_Recency) AS "Avg Recency", Avg_Frequency,
               'R$ ' || format('{{:,.2f}}', Avg_Spend) AS "Avg Customer Spend",
               'R$ ' || format('{{:,.2f}}', Total_Revenue) AS "Total Spend",
               printf('%.1f%%', Customer_Pct) AS "% Customers", printf('%.1f%%', Revenue_Pct) AS "% Revenue",
               Strategic_Action AS "Strategic Playbook"
        FROM ({SEGMENTS})""",
    fmt_pareto="""
        SELECT Category AS "Product Category", 'R$ ' || format('{:,.2f}', Revenue) AS "Gross Revenue",
               Cumulative_Revenue, printf('%.1f%%', Cumulative_Pct) AS "Cumulative Share",
               printf('%.1f%%', Revenue_Share_Pct) AS "Share of GMV", Is_Top_80 AS "Top 80% Contributor"
        FROM pareto""",
    fmt_state=f"""
        SELECT customer_state AS "State", format('{{:,}}', Total_Orders) AS "Delivered Orders",
               'R$ ' || format('{{:,.2f}}', Total_Revenue) AS "Gross Revenue",
               printf('%.1f days', Avg_Delivery_Days) AS "Avg Delivery Time",
               printf('%.1f%%', Late_Delivery_Pct) AS "Late Delivery Rate",
               printf('R$ %.2f', Avg_Freight_Cost) AS "Avg Freight",
               printf('%.2f ⭐', Avg_Review_Score) AS "Avg Review Score"
        FROM ({BY_STATE})""",
    fmt_payment=f"""
        SELECT payment_type AS "Payment Method", format('{{:,}}', Orders) AS "Transaction Volume",
               'R$ ' || format('{{:,.2f}}', Total_Spend) AS "Gross Payment Volume",
               'R$ ' || format('{{:,.2f}}', Avg_Ticket) AS "Average Order Value (AOV)",
               printf('%.1fx', Avg_Installments) AS "Average Installments"
        FROM ({CHANNELS})""",
)

# --- named queries, unfiltered and filtered ----------------------------------------------------


def named_queries(source: str, done: str) -> dict[str, str]:
    """The seven statements over a master relation and its delivered part."""
    return {
        "q1": f"""
            SELECT category_english AS category, count(DISTINCT order_id) AS total_orders,
                   count(product_id) AS items_sold, {up('sum(total_order_value)::DOUBLE')} AS gross_revenue,
                   {up(mean('price'))} AS avg_item_price, {up(mean('review_score'))} AS avg_review_score,
                   {up(frac(up('sum(total_order_value)::DOUBLE'), 'sum(sum(total_order_value)) OVER ()') + ' * 100.0')}
                       AS revenue_share_pct
            FROM {done} GROUP BY category_english ORDER BY gross_revenue DESC, category LIMIT 10""",
        "q2": f"""
            SELECT customer_state AS state, count(DISTINCT order_id) AS order_volume,
                   {up('sum(total_order_value)::DOUBLE')} AS total_revenue,
                   {up(mean('total_order_value'))} AS avg_order_value,
                   {up(mean('freight_value'))} AS avg_freight_cost,
                   {up(pct(mean('freight_value'), mean('total_order_value')))} AS freight_to_revenue_ratio_pct,
                   {up(TRANSIT, 1)} AS avg_delivery_days, {up(rows_where('is_late'))} AS late_delivery_rate_pct
            FROM {done} GROUP BY customer_state ORDER BY total_revenue DESC, state LIMIT 10""",
        "q3": f"""
            WITH monthly AS (
                SELECT order_year_month AS period, count(DISTINCT order_id) AS monthly_orders,
                       {up('sum(total_order_value)::DOUBLE')} AS monthly_revenue,
                       {up(mean('total_order_value'))} AS monthly_aov
                FROM {done} GROUP BY order_year_month)
            SELECT *, {up(pct('monthly_revenue - lag(monthly_revenue) OVER w', 'lag(monthly_revenue) OVER w'))}
                          AS revenue_growth_pct,
                   {up(pct('monthly_orders - lag(monthly_orders) OVER w', 'lag(monthly_orders) OVER w'))}
                          AS order_growth_pct
            FROM monthly WINDOW w AS (ORDER BY period)""",
        "q4": f"""
            WITH people AS (
                SELECT customer_unique_id AS c, count(DISTINCT order_id) AS n,
                       {up('sum(total_order_value)::DOUBLE')}::DECIMAL(18,2) AS spend,
                       {up(mean('total_order_value'))}::DECIMAL(18,2) AS aov
                FROM {done} GROUP BY customer_unique_id)
            SELECT if(n > 1, 'Repeat Customer', 'One-Time Customer') AS customer_type,
                   count(c) AS total_customers, {up(pct('count(c)', 'sum(count(c)) OVER ()'))} AS customer_base_pct,
                   {up('sum(spend)::DOUBLE')} AS aggregate_revenue,
                   {up(pct('sum(spend)', 'sum(sum(spend)) OVER ()'))} AS revenue_contribution_pct,
                   {up(mean('spend'))} AS avg_clv, {up(mean('aov'))} AS avg_order_value
            FROM people GROUP BY customer_type""",
        "q5": f"""
            SELECT payment_type, count(DISTINCT order_id) AS transaction_count,
                   {up('sum(total_order_value)::DOUBLE')} AS total_volume_brl,
                   {up(pct('sum(total_order_value)', 'sum(sum(total_order_value)) OVER ()'))} AS volume_share_pct,
                   {up(mean('total_order_value'))} AS avg_ticket_size,
                   {up(mean('payment_installments'), 1)} AS avg_installments,
                   max(payment_installments) AS max_installments
            FROM {source} GROUP BY payment_type""",
        "q6": f"""
            SELECT {DELAY_CASE.format(*TIERS)} AS delay_tier, count(order_id) AS total_orders,
                   {up(mean('review_score'))} AS avg_review_score,
                   {up(rows_where('review_score = 1'))} AS pct_1_star_reviews,
                   {up(rows_where('review_score = 5'))} AS pct_5_star_reviews
            FROM {done} WHERE review_score IS NOT NULL AND delivery_delay_days IS NOT NULL GROUP BY delay_tier""",
        "q7": f"""
            SELECT category_english AS category, count(DISTINCT order_id) AS total_orders,
                   {up('sum(total_order_value)::DOUBLE')} AS category_revenue,
                   {up(mean('review_score'))} AS avg_review_score,
                   {up(rows_where('review_score <= 2'))} AS negative_review_pct,
                   {up(TRANSIT, 1)} AS avg_delivery_days, {up(mean('freight_value'))} AS avg_freight
            FROM {done} GROUP BY category_english HAVING count(DISTINCT order_id) >= 100
            ORDER BY negative_review_pct DESC, category LIMIT 10""",
    }


FULL_NAMES = {
    "q1": "q1_top_categories",
    "q2": "q2_state_sales_freight",
    "q3": "q3_mom_growth",
    "q4": "q4_repeat_vs_onetime",
    "q5": "q5_payment_installments",
    "q6": "q6_delivery_delay_reviews",
    "q7": "q7_underperforming_categories",
}
add(**{FULL_NAMES[k]: v for k, v in named_queries("master", "delivered").items()})
add(**{f"lab_filtered_{k}": v for k, v in named_queries("filtered", "filtered_delivered").items()})

add(
    lab_sql_text="""
        SELECT customer_state, count(*) AS active_months, sum(orders)::BIGINT AS total_orders,
               max(orders) AS best_month_orders, sum(revenue)::DOUBLE AS total_revenue
        FROM (SELECT customer_state, count(DISTINCT order_id) AS orders, sum(total_order_value) AS revenue
              FROM delivered GROUP BY customer_state, order_year_month)
        GROUP BY customer_state"""
)

# --- customers ---------------------------------------------------------------------------------

add(
    cust_count="SELECT count(*) AS total_customer_records FROM p_customers",
    cust_by_state="SELECT customer_state, count(*) AS total_customers FROM p_customers GROUP BY ALL",
    cust_by_state_asc="SELECT customer_state, count(*) AS total_customers FROM p_customers GROUP BY ALL",
    cust_top_states="""
        SELECT customer_state, count(*) AS total_customers FROM p_customers GROUP BY ALL
        ORDER BY total_customers DESC, customer_state LIMIT 10""",
    cust_unique="SELECT count(DISTINCT customer_unique_id) AS unique_customers FROM p_customers",
    cust_top_cities="""
        SELECT customer_city, customer_state, count(*) AS total_customers FROM p_customers GROUP BY ALL
        ORDER BY total_customers DESC, customer_city, customer_state LIMIT 10""",
    cust_multi_record="""
        SELECT customer_unique_id, count(*) AS records FROM p_customers GROUP BY ALL HAVING count(*) > 1""",
    cust_multi_record_count="""
        SELECT count(*) AS duplicate_customer_records
        FROM (SELECT 1 FROM p_customers GROUP BY customer_unique_id HAVING count(*) > 1)""",
    cust_cities="SELECT count(DISTINCT customer_city) AS total_cities FROM p_customers",
    cust_cities_by_state="""
        SELECT customer_state, count(DISTINCT customer_city) AS total_cities FROM p_customers GROUP BY ALL""",
    cust_top_city_states="""
        SELECT customer_state, count(DISTINCT customer_city) AS number_of_cities FROM p_customers GROUP BY ALL
        ORDER BY number_of_cities DESC, customer_state LIMIT 10""",
    cust_in_state="SELECT * FROM p_customers WHERE customer_state = 'NATION_0'",
    cust_frequency_dist="""
        SELECT records, count(*) AS customers
        FROM (SELECT count(customer_id) AS records FROM p_customers GROUP BY customer_unique_id) GROUP BY ALL""",
)

# --- orders ------------------------------------------------------------------------------------

DONE = "order_status = 'delivered'"
OVERDUE = days("order_delivered_customer_date", "order_estimated_delivery_date")
SPENT = days("order_delivered_customer_date", "order_purchase_timestamp")
LATE_ROWS = f"SELECT order_id, {up(OVERDUE)} AS days_late FROM p_orders WHERE {DONE} AND {LATE}"
add(
    ord_count="SELECT count(*) AS total_orders FROM p_orders",
    ord_by_status="SELECT order_status, count(*) AS total_orders FROM p_orders GROUP BY ALL",
    ord_status_share=f"""
        SELECT order_status, count(*) AS total_orders,
               {up(pct('count(*)', 'sum(count(*)) OVER ()'))} AS percentage_of_orders
        FROM p_orders GROUP BY order_status""",
    ord_delivered_pct=f"SELECT {up(rows_where(DONE))} AS delivered_percentage FROM p_orders",
    ord_success_rate=f"SELECT {up(rows_where(DONE))} AS success_rate FROM p_orders",
    ord_canceled_pct="SELECT "
    + up(rows_where("order_status = 'canceled'"))
    + " AS canceled_percentage FROM p_orders",
    ord_delivered_count=f"SELECT count(*) FILTER (WHERE {DONE}) AS delivered_orders FROM p_orders",
    ord_by_year="SELECT year(order_purchase_timestamp) AS year, count(*) AS total_orders FROM p_orders GROUP BY ALL",
    ord_by_month="""
        SELECT date_trunc('month', order_purchase_timestamp)::TIMESTAMP AS month, count(*) AS total_orders
        FROM p_orders GROUP BY ALL""",
    ord_by_weekday="""
        SELECT dayname(order_purchase_timestamp) AS day_of_week, count(*) AS total_orders FROM p_orders GROUP BY ALL""",
    ord_by_hour="""
        SELECT hour(order_purchase_timestamp) AS order_hour, count(*) AS total_orders FROM p_orders GROUP BY ALL""",
    ord_late_summary=f"""
        SELECT count(order_id) AS total_late_orders, {up(mean(LATE_DAYS))} AS avg_days_late
        FROM p_orders WHERE {DONE} AND {LATE_DAYS} > 0""",
    ord_avg_delay=f"SELECT {up(mean(LATE_DAYS))} AS avg_delay FROM p_orders WHERE {LATE}",
    ord_bottleneck_states=f"""
        SELECT customer_state, count(order_id) AS late_order_count, {up(mean(LATE_DAYS))} AS avg_delay
        FROM p_orders JOIN p_customers USING (customer_id) WHERE {LATE} GROUP BY customer_state
        ORDER BY avg_delay DESC, customer_state LIMIT 10""",
    ord_delivery_time=f"""
        SELECT order_id, order_purchase_timestamp, order_delivered_customer_date,
               (epoch_us(order_delivered_customer_date) - epoch_us(order_purchase_timestamp)) / 1e6 AS delivery_time
        FROM p_orders WHERE {DONE} AND order_delivered_customer_date IS NOT NULL""",
    ord_avg_delivery_days=f"SELECT {up(TRANSIT)} AS average_delivery_days FROM p_orders WHERE {DONE}",
    ord_late_count=f"SELECT count(*) AS late_orders FROM p_orders WHERE {DONE} AND {LATE}",
    ord_late_pct=f"""
        SELECT {up(rows_where(LATE))} AS late_delivery_percentage FROM p_orders
        WHERE {DONE} AND order_delivered_customer_date IS NOT NULL
          AND order_estimated_delivery_date IS NOT NULL""",
    ord_late_pct_all=f"""
        SELECT count(*) FILTER (WHERE {LATE}) AS late_orders, {rows_where(LATE)} AS late_percentage
        FROM p_orders WHERE order_delivered_customer_date IS NOT NULL""",
    ord_days_late=LATE_ROWS,
    ord_top10_delayed=f"{LATE_ROWS} ORDER BY days_late DESC, order_id LIMIT 10",
    ord_missing_dates="SELECT "
    + ", ".join(
        f"count(*) - count({c}) AS {name}"
        for c, name in zip(
            DATES,
            [
                "missing_purchase_date",
                "missing_approval_date",
                "missing_carrier_date",
                "missing_customer_delivery_date",
                "missing_estimated_date",
            ],
            strict=True,
        )
    )
    + " FROM p_orders",
    ord_approval_hours="SELECT "
    + up(mean_days("order_approved_at", "order_purchase_timestamp", 3600.0))
    + " AS avg_approval_hours FROM p_orders",
    ord_days_to_carrier="SELECT "
    + up(mean_days("order_delivered_carrier_date", "order_approved_at"))
    + " AS avg_days_to_carrier FROM p_orders",
    ord_over_30_days=f"""
        SELECT order_id, {up(SPENT)} AS delivery_days FROM p_orders
        WHERE {DONE} AND order_delivered_customer_date > order_purchase_timestamp + INTERVAL 30 DAY""",
    ord_performance=f"""
        SELECT CASE WHEN {LATE} THEN 'Late' WHEN NOT ({LATE}) THEN 'On Time' ELSE 'Unknown' END
                   AS delivery_performance, count(*) AS total_orders
        FROM p_orders WHERE {DONE} GROUP BY ALL""",
    eda_delivery_counts=f"""
        SELECT CASE WHEN floor({OVERDUE}) > 0 THEN 'Late' ELSE 'On Time' END AS delivery_performance,
               count(*) AS total_orders
        FROM p_orders WHERE {DONE} GROUP BY ALL""",
    prf_time_span="""
        SELECT min(order_purchase_timestamp) AS first_order, max(order_purchase_timestamp) AS last_order
        FROM p_orders""",
)

# --- reviews -----------------------------------------------------------------------------------

LISTED = "review_id, order_id, review_score, review_comment_message, review_creation_date"
add(
    rev_count="SELECT count(*) AS total_reviews FROM p_reviews",
    rev_by_score="SELECT review_score, count(*) AS total_reviews FROM p_reviews GROUP BY ALL",
    rev_five_star_pct=f"SELECT {up(rows_where('review_score = 5'))} AS five_star_percentage FROM p_reviews",
    rev_one_star_pct=f"SELECT {up(rows_where('review_score = 1'))} AS one_star_percentage FROM p_reviews",
    rev_avg=f"SELECT {up(mean('review_score'))} AS average_review_score FROM p_reviews",
    rev_sentiment="""
        SELECT CASE WHEN review_score < 3 THEN 'Unhappy' WHEN review_score = 3 THEN 'Neutral'
                    WHEN review_score > 3 THEN 'Happy' END AS customer_sentiment, count(*) AS total_reviews
        FROM p_reviews GROUP BY ALL""",
    rev_unhappy_pct=f"SELECT {up(rows_where('review_score < 3'))} AS unhappy_percentage FROM p_reviews",
    rev_monthly_avg=f"""
        SELECT date_trunc('month', review_creation_date)::TIMESTAMP AS review_month,
               {up(mean('review_score'))} AS average_rating
        FROM p_reviews GROUP BY review_month""",
    rev_monthly_count="""
        SELECT date_trunc('month', review_creation_date)::TIMESTAMP AS review_month, count(*) AS total_reviews
        FROM p_reviews GROUP BY ALL""",
    rev_comment_count=f"SELECT count(*) FILTER (WHERE {FILLED}) AS reviews_with_comments FROM p_reviews",
    rev_comment_pct=f"SELECT {up(rows_where(FILLED))} AS comment_percentage FROM p_reviews",
    rev_missing_score="SELECT count(*) - count(review_score) AS missing_review_scores FROM p_reviews",
    rev_duplicate_ids="""
        SELECT review_id, count(*) AS occurrences FROM p_reviews GROUP BY ALL HAVING count(*) > 1""",
    rev_comments_by_score=f"""
        SELECT review_score, count(*) FILTER (WHERE {FILLED}) AS reviews_with_comments FROM p_reviews GROUP BY ALL""",
    rev_comment_totals=f"""
        SELECT review_score, count(*) AS total_reviews, count(*) FILTER (WHERE {FILLED}) AS reviews_with_comments
        FROM p_reviews GROUP BY ALL""",
    rev_latest=f"""
        SELECT {LISTED} FROM p_reviews
        ORDER BY review_creation_date DESC NULLS FIRST, review_id, order_id LIMIT 10""",
    rev_latest_unhappy=f"""
        SELECT {LISTED} FROM p_reviews WHERE review_score < 3
        ORDER BY review_creation_date DESC NULLS FIRST, review_id, order_id LIMIT 20""",
    rev_longest="""
        SELECT review_id, review_score, length(review_comment_message) AS comment_length, review_comment_message
        FROM p_reviews WHERE review_comment_message IS NOT NULL
        ORDER BY comment_length DESC, review_id, review_score NULLS FIRST LIMIT 10""",
    rev_category_share=f"""
        SELECT CASE WHEN review_score > 3 THEN 'Positive' WHEN review_score = 3 THEN 'Neutral'
                    ELSE 'Negative' END AS review_category, count(*) AS total_reviews,
               {up(pct('count(*)', 'sum(count(*)) OVER ()'))} AS percentage
        FROM p_reviews GROUP BY review_category""",
    rev_by_delivery=f"""
        SELECT CASE WHEN {LATE} THEN 'Late' ELSE 'On Time' END AS delivery_status,
               count(review_id) AS total_reviews, {up(mean('review_score'))} AS average_review_score
        FROM p_reviews JOIN p_orders USING (order_id)
        WHERE {DONE} AND order_delivered_customer_date IS NOT NULL
          AND order_estimated_delivery_date IS NOT NULL
        GROUP BY delivery_status""",
    dq_comments=f"""
        SELECT count(review_comment_message) AS with_comment,
               count(*) - count(review_comment_message) AS without_comment,
               {pct('count(review_comment_message)', 'count(*)')} AS with_comment_pct,
               100.0 - {pct('count(review_comment_message)', 'count(*)')} AS without_comment_pct
        FROM p_reviews""",
)

# --- exploration and data quality --------------------------------------------------------------


def describe(source: str, keys: str = "", scale: str = "") -> str:
    """Summary statistics of an exact decimal column ``v``."""
    values = {
        "mean": "s::DOUBLE / n",
        "std": "sqrt(greatest((ss::DOUBLE - s::DOUBLE * s::DOUBLE / n) / (n - 1.0), 0))",
        "min": "lo",
        "p25": "p25",
        "p50": "p50",
        "p75": "p75",
        "max": "hi",
    }
    shown = ", ".join(f"({expr}){scale} AS {name}" for name, expr in values.items())
    lead = f"{keys}, " if keys else ""
    return f"""
        SELECT {lead} n AS count, {shown} FROM (
            SELECT {lead} count(*) AS n, sum(v) AS s, sum(v::DECIMAL(20,6) * v::DECIMAL(18,6)) AS ss, min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi,
                   quantile_cont(v::DOUBLE, 0.25) AS p25, quantile_cont(v::DOUBLE, 0.5) AS p50,
                   quantile_cont(v::DOUBLE, 0.75) AS p75
            FROM ({source}) GROUP BY ALL)
    """


def seconds(later: str, earlier: str) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) / 1e6)::DECIMAL(18,6)"


TABLES = {
    "customers": ("p_customers", "customer_id customer_unique_id customer_zip_code_prefix customer_city customer_state"),
    "orders": ("p_orders", "order_id customer_id order_status " + " ".join(DATES)),
    "order_items": ("p_items", "order_id order_item_id product_id seller_id price freight_value"),
    "products": (
        "p_products",
        "product_id product_category_name product_weight_g product_length_cm product_height_cm product_width_cm",
    ),
    "payments": ("p_payments", "order_id payment_sequential payment_type payment_installments payment_value"),
    "reviews": ("p_reviews", "review_id order_id review_score review_comment_message review_creation_date"),
    "sellers": ("p_sellers", "seller_id seller_zip_code_prefix seller_state"),
    "category_translation": ("p_translation", "product_category_name product_category_name_english"),
    "geolocation": ("p_geolocation", "geolocation_zip_code_prefix geolocation_city geolocation_state"),
}


def kind(column: str) -> str:
    if column in DATES or column == "review_creation_date":
        return "timestamp"
    if column in ("price", "freight_value", "payment_value"):
        return "decimal"
    if column.startswith("product_") and column.endswith(("_g", "_cm")):
        return "double"
    text = ("_city", "_state", "_status", "_type", "_message", "_name", "_english")
    return "text" if column.endswith(text) else "integer"


REFERENCES = [
    ("orders", "customer_id", "customers", "customer_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("order_items", "seller_id", "sellers", "seller_id"),
    ("payments", "order_id", "orders", "order_id"),
    ("reviews", "order_id", "orders", "order_id"),
    ("products", "product_category_name", "category_translation", "product_category_name"),
    ("customers", "customer_zip_code_prefix", "geolocation", "geolocation_zip_code_prefix"),
]
SALES = "GMV, Orders, Average_Order_Value"
add(
    eda_monthly_sales="SELECT * FROM sales_months",
    eda_best_worst_month=f"""
        (SELECT 'best' AS kind, month, {SALES} FROM sales_months ORDER BY GMV DESC, month LIMIT 1)
        UNION ALL (SELECT 'worst', month, {SALES} FROM sales_months ORDER BY GMV, month LIMIT 1)""",
    eda_aov_extremes=f"""
        (SELECT 'highest' AS kind, month, {SALES} FROM sales_months ORDER BY Average_Order_Value DESC, month LIMIT 1)
        UNION ALL
        (SELECT 'lowest', month, {SALES} FROM sales_months ORDER BY Average_Order_Value, month LIMIT 1)""",
    eda_aov=f"""
        SELECT (SELECT sum(GMV::DECIMAL(18,2))::DOUBLE / sum(Orders) FROM sales_months) AS monthly_aov,
               sum(price)::DOUBLE AS total_revenue, count(DISTINCT order_id) AS total_orders,
               {frac('sum(price)', 'count(DISTINCT order_id)')} AS item_aov
        FROM p_items""",
    eda_category_gmv="""
        SELECT product_category_name, sum(price)::DOUBLE AS gmv FROM p_items JOIN p_products USING (product_id)
        WHERE product_category_name IS NOT NULL GROUP BY ALL ORDER BY gmv DESC, product_category_name LIMIT 10""",
    eda_category_orders="""
        SELECT product_category_name, count(DISTINCT order_id) AS orders
        FROM p_items JOIN p_products USING (product_id)
        WHERE product_category_name IS NOT NULL GROUP BY ALL ORDER BY orders DESC, product_category_name LIMIT 10""",
    eda_customer_orders=describe("SELECT orders::DECIMAL(18,6) AS v FROM per_customer"),
    eda_repeat_rate=f"""
        SELECT count(*) FILTER (WHERE orders > 1) AS repeat_customers,
               count(*) FILTER (WHERE orders <= 1) AS one_time_customers, {rows_where('orders > 1')} AS repeat_rate
        FROM per_customer""",
    prf_delivery_describe=describe(
        f"""
        SELECT 'delivery_days' AS metric,
               {seconds('order_delivered_customer_date', 'order_purchase_timestamp')} AS v
        FROM p_orders WHERE order_delivered_customer_date IS NOT NULL
        UNION ALL
        SELECT 'delivery_delay_days', {seconds('order_delivered_customer_date', 'order_estimated_delivery_date')}
        FROM p_orders WHERE order_delivered_customer_date IS NOT NULL""",
        keys="metric",
        scale=" / 86400.0",
    ),
    prf_money=f"""
        SELECT sum(price)::DOUBLE AS total_product_value, sum(freight_value)::DOUBLE AS total_freight,
               {mean('price')} AS average_product_price
        FROM p_items""",
    prf_numeric=describe(
        " UNION ALL ".join(
            f"SELECT '{name}' AS table_name, '{c}' AS metric, {c}::DECIMAL(18,6) AS v FROM {source} WHERE {c} IS NOT NULL"
            for name, (source, columns) in TABLES.items()
            for c in columns.split()
            if kind(c) in ("integer", "decimal", "double") and (not c.endswith("_id") or c == "order_item_id")
        ),
        keys="table_name, metric",
    ),
    prf_schema=" UNION ALL ".join(
        f"SELECT '{name}' AS table_name, {i}::INT AS position, '{c}' AS column_name, '{kind(c)}' AS kind, "
        f"count(*) AS row_count FROM {source}"
        for name, (source, columns) in TABLES.items()
        for i, c in enumerate(columns.split(), start=1)
    ),
    dq_nulls=" UNION ALL ".join(
        f"SELECT '{name}' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS missing_count, "
        f"{pct(f'count(*) - count({c})', 'count(*)')} AS missing_percentage FROM {source}"
        for name, (source, columns) in TABLES.items()
        for c in columns.split()
    ),
    dq_duplicates=" UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source})) "
        f"AS duplicate_rows FROM {source}"
        for name, (source, _) in TABLES.items()
    ),
    dq_distinct="SELECT count(DISTINCT customer_state) AS distinct_values FROM p_customers",
    dq_nulls_by_status="SELECT order_status, "
    + ", ".join(f"count(*) - count({c}) AS {c}" for c in DATES[1:4])
    + " FROM p_orders GROUP BY order_status",
    dq_missing_category=" UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count "
        "FROM p_products WHERE product_category_name IS NULL"
        for c in TABLES["products"][1].split()
    ),
    dq_missing_category_sales="""
        SELECT count(*) AS sold_lines, sum(price + freight_value)::DOUBLE AS revenue_with_freight,
               sum(price)::DOUBLE AS revenue, count(DISTINCT product_id) AS products
        FROM p_items
        WHERE product_id IN (SELECT product_id FROM p_products WHERE product_category_name IS NULL)""",
    dq_orphans=" UNION ALL ".join(
        f"SELECT '{child}.{key} -> {parent}' AS reference, count(*) AS orphan_rows, "
        f"count(DISTINCT {key}) AS orphan_keys FROM {TABLES[child][0]} WHERE {key} IS NOT NULL "
        f"AND {key} NOT IN (SELECT {target} FROM {TABLES[parent][0]} WHERE {target} IS NOT NULL)"
        for child, key, parent, target in REFERENCES
    ),
)

# --- sampling, features, metrics ---------------------------------------------------------------

ORDER_KEY = "md5(concat(order_id, ':42')), order_id"
CONFUSION = """
    SELECT count(*) FILTER (WHERE label = 0 AND score < 0.45) AS tn,
           count(*) FILTER (WHERE label = 0 AND score >= 0.45) AS fp,
           count(*) FILTER (WHERE label = 1 AND score < 0.45) AS fn,
           count(*) FILTER (WHERE label = 1 AND score >= 0.45) AS tp
    FROM rule_scored
"""
GAP = [
    ("Early (-5d+)", "delivery_delta_days <= -5"),
    ("On-Time (-5d to 0d)", "delivery_delta_days > -5 AND delivery_delta_days <= 0"),
    ("Mild Delay (+1 to +3d)", "delivery_delta_days > 0 AND delivery_delta_days <= 3"),
    ("Moderate Delay (+4 to +7d)", "delivery_delta_days > 3 AND delivery_delta_days <= 7"),
    ("Severe Delay (+8d+)", "delivery_delta_days > 7"),
]
ADVICE = {
    "route": "📍 **Regional Routing:** Re-route package through a local cross-dock center to eliminate "
    "interstate transfer choke-points.",
    "sla": "⏱️ **SLA Realignment:** Estimated delivery window is too aggressive for this postal corridor. "
    "Extend customer SLA by +2 days.",
    "heavy": "📦 **Heavy Freight Protocol:** Switch from standard postal carrier to specialized road logistics "
    "partner for heavy items (>6kg).",
    "fine": "✅ **Optimal Fulfillment:** Logistics parameters are well-balanced; automated carrier dispatch "
    "recommended.",
}
add(
    smp_fixed_n=f"SELECT order_id, customer_state FROM master ORDER BY {ORDER_KEY} LIMIT 1000",
    smp_stratified_split=f"""
        SELECT order_id, is_late,
               row_number() OVER (PARTITION BY is_late ORDER BY {ORDER_KEY})
                   <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY is_late)) AS is_test
        FROM master""",
    ml_first_orders="""
        SELECT * REPLACE (price::DOUBLE AS price, freight_value::DOUBLE AS freight_value) FROM first_order""",
    ml_repeat_features="SELECT * FROM repeat_features",
    ml_delay_features_master="SELECT * FROM master_delay_features",
    ml_delay_features="SELECT * FROM delay_features",
    ml_csat_features="SELECT * FROM csat_features",
    csat_expectation_gap=" UNION ALL ".join(
        f"SELECT '{label}' AS delta_bucket, {mean('review_score')} AS avg_review, "
        f"{rows_where('review_score = 1')} AS pct_1_star, count(review_score) AS order_count "
        f"FROM csat_features WHERE {condition}"
        for label, condition in GAP
    ),
    ml_threshold_metrics=f"""
        SELECT coalesce({frac('tp', 'tp + fp')}, 0) AS precision, coalesce({frac('tp', 'tp + fn')}, 0) AS recall,
               coalesce({frac('tp * 2', 'tp * 2 + fp + fn')}, 0) AS f1,
               coalesce({frac('tp + tn', 'tn + fp + fn + tp')}, 0) AS accuracy,
               {pct('tp + fn', 'tn + fp + fn + tp')} AS base_rate, tn, fp, fn, tp,
               tn + fp + fn + tp AS sample_size
        FROM ({CONFUSION})""",
    ml_confusion_pct=f"""
        SELECT actual, predicted, orders, {pct('orders', 'sum(orders) OVER ()')} AS pct FROM (
            SELECT 0 AS actual, 0 AS predicted, tn AS orders FROM ({CONFUSION})
            UNION ALL SELECT 0, 1, fp FROM ({CONFUSION}) UNION ALL SELECT 1, 0, fn FROM ({CONFUSION})
            UNION ALL SELECT 1, 1, tp FROM ({CONFUSION}))""",
    ml_roc_auc="""
        WITH ranked AS (
            SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r
            FROM rule_scored),
        sums AS (SELECT sum(r * label) AS rs, sum(label) AS p, count(*) - sum(label) AS n FROM ranked)
        SELECT (rs * 2 - p * (p + 1))::DOUBLE / (p::DOUBLE * n * 2) AS roc_auc, (p + n)::BIGINT AS sample_size
        FROM sums""",
    ml_avg_precision="""
        WITH g AS (SELECT score, sum(label) AS pos, count(*) AS n FROM rule_scored GROUP BY score),
        c AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM g WINDOW w AS (ORDER BY score DESC))
        SELECT round(sum(pos * tp::DOUBLE / seen) / sum(pos), 9) AS pr_auc FROM c""",
    ml_recommendation_rules=f"""
        WITH scored AS (
            SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (24.0 - estimated_days) / 14.0)) AS p
            FROM delay_features),
        listed AS (
            SELECT order_id, p, concat_ws(chr(10),
                CASE WHEN is_interstate = 1 AND p > 0.30 THEN '{ADVICE["route"]}' END,
                CASE WHEN estimated_days < 14 AND p > 0.35 THEN '{ADVICE["sla"]}' END,
                CASE WHEN product_weight_g > 6000 THEN '{ADVICE["heavy"]}' END) AS text FROM scored)
        SELECT order_id, CASE WHEN p >= 0.55 THEN 'Critical Risk' WHEN p >= 0.28 THEN 'Moderate Risk'
                              ELSE 'Low Risk' END AS tier,
               CASE WHEN text = '' THEN '{ADVICE["fine"]}' ELSE text END AS recommendations
        FROM listed""",
)

# --- time series and what-if -------------------------------------------------------------------

GRID = """
    SELECT a / 10.0::DOUBLE AS alpha, b / 10.0::DOUBLE AS beta, p::DOUBLE / 100 AS phi
    FROM range(1, 10) AS x(a), range(1, 6) AS y(b), (VALUES (80), (85), (90), (95), (98)) AS z(p)
"""


def walked(drop: int) -> str:
    """Recursive smoothing of every series under every parameter set, leaving out the last months."""
    return f"""
        WITH RECURSIVE grid AS ({GRID}),
        walk AS (
            SELECT customer_state, y, months, last_month, alpha, beta, phi, 1 AS t, y[1] AS level,
                   y[2] - y[1] AS trend, 0.0::DOUBLE AS sse, 0.0::DOUBLE AS bias
            FROM lines, grid WHERE months >= 12
            UNION ALL
            SELECT customer_state, y, months, last_month, alpha, beta, phi, t + 1,
                   alpha * y[t + 1] + (1.0 - alpha) * (level + phi * trend),
                   beta * ((alpha * y[t + 1] + (1.0 - alpha) * (level + phi * trend)) - level)
                       + (1.0 - beta) * (phi * trend),
                   sse + (y[t + 1] - (level + phi * trend)) * (y[t + 1] - (level + phi * trend)),
                   bias + (y[t + 1] - (level + phi * trend))
            FROM walk WHERE t < months - {drop}),
        best AS (
            SELECT * FROM walk WHERE t = months - {drop}
            QUALIFY row_number() OVER (PARTITION BY customer_state ORDER BY sse, alpha, beta, phi) = 1),
        fitted AS (
            SELECT *, sqrt(greatest(sse / (t - 1.0) - (bias / (t - 1.0)) * (bias / (t - 1.0)), 0)) AS residual_std
            FROM best)
    """


def damped(step: str) -> str:
    return f"(level + trend * list_sum(list_transform(range(1, {step} + 1), lambda i: pow(phi, i))))"


FALLBACK = """
    SELECT customer_state, k::INT AS step, strftime(last_month + to_months(k::INT), '%Y-%m') AS ds,
           y[months] * ([1.02, 1.05, 1.08, 1.16, 1.25, 1.12]::DOUBLE[])[k] AS forecast
    FROM lines, range(1, 7) AS s(k)
"""
BANDED = f"""
    SELECT *, forecast * 0.92::DOUBLE AS ci_80_lower, forecast * 1.08::DOUBLE AS ci_80_upper,
           forecast * 0.85::DOUBLE AS ci_95_lower, forecast * 1.15::DOUBLE AS ci_95_upper
    FROM ({FALLBACK})
"""
BANDS = ["ci_80_lower", "ci_80_upper", "ci_95_lower", "ci_95_upper"]
FITTED_AHEAD = f"""
    {walked(0)}
    SELECT customer_state, step, ds, forecast,
           greatest(0.0::DOUBLE, forecast - 1.28::DOUBLE * residual_std * sqrt(step)) AS ci_80_lower,
           forecast + 1.28::DOUBLE * residual_std * sqrt(step) AS ci_80_upper,
           greatest(0.0::DOUBLE, forecast - 1.96::DOUBLE * residual_std * sqrt(step)) AS ci_95_lower,
           forecast + 1.96::DOUBLE * residual_std * sqrt(step) AS ci_95_upper
    FROM (SELECT *, k::INT AS step, strftime(last_month + to_months(k::INT), '%Y-%m') AS ds,
                 {damped('k')} AS forecast
          FROM fitted, range(1, 7) AS s(k))
"""
ALL_AHEAD = f"""
    {FITTED_AHEAD}
    UNION ALL SELECT customer_state, step, ds, forecast, ci_80_lower, ci_80_upper, ci_95_lower, ci_95_upper
    FROM ({BANDED}) JOIN lines USING (customer_state) WHERE months < 12
"""
add(
    ts_monthly="SELECT * FROM state_months",
    ts_damped_fit=f"""
        {walked(0)}
        SELECT customer_state, months::INT AS months, alpha, beta, phi, level, trend, sse, residual_std FROM fitted""",
    ts_backtest=f"""
        {walked(4)}
        SELECT customer_state, {even('avg(abs((actual - guess) / actual)) * 100.0')} AS mape,
               {even('avg(abs(actual - guess))')} AS mae, any_value(months)::INT AS months
        FROM (SELECT customer_state, months, y[months - 4 + k] AS actual, {damped('k')} AS guess
              FROM fitted, range(1, 5) AS s(k))
        GROUP BY customer_state""",
    ts_forecast=FITTED_AHEAD,
    ts_forecast_all=ALL_AHEAD,
    ts_fallback=BANDED,
    ts_quarter_growth=f"""
        WITH ahead AS (
            SELECT customer_state, list_sum(list(forecast ORDER BY step)) AS projected FROM ({ALL_AHEAD})
            WHERE step <= 3 GROUP BY customer_state),
        recent AS (SELECT customer_state, list_sum(y[greatest(1, months - 2):months]) AS r FROM lines)
        SELECT customer_state, {even('projected')} AS projected_revenue, r AS recent_revenue,
               {even('CASE WHEN r > 0 THEN (projected - r) / r * 100.0 ELSE 12.5 END', 1)} AS projected_growth_rate
        FROM ahead JOIN recent USING (customer_state)""",
    ts_scenarios="SELECT customer_state, step, ds, "
    + ", ".join(f"{c} * multiplier AS {c}" for c in ["forecast", *BANDS])
    + f""", scenario, multiplier
        FROM ({ALL_AHEAD}), (VALUES ('Baseline', 1.0::DOUBLE), ('Optimistic', 1.1::DOUBLE),
                                 ('Conservative', 0.9::DOUBLE)) AS v(scenario, multiplier)""",
    fmt_forecast='SELECT customer_state, ds AS "Forecast Month", '
    + ", ".join(
        f"'R$ ' || format('{{:,.2f}}', {c}) AS \"{name}\""
        for c, name in zip(
            ["forecast", *BANDS],
            ["Forecast GMV", "80% CI Lower", "80% CI Upper", "95% CI Lower", "95% CI Upper"],
            strict=True,
        )
    )
    + f" FROM ({ALL_AHEAD})",
    whatif_sweep=f"""
        WITH base AS (
            SELECT customer_state, count(DISTINCT order_id) AS total_orders,
                   sum(total_order_value)::DOUBLE AS total_revenue,
                   {frac('sum(total_order_value)', 'count(DISTINCT order_id)')} AS aov
            FROM delivered GROUP BY customer_state),
        swept AS (
            SELECT base.*, i * 0.5::DOUBLE AS days_saved, j * 0.5::DOUBLE AS retention_points
            FROM base, range(0, 13) AS d(i), range(0, 17) AS r(j)),
        effect AS (
            SELECT *, floor(total_orders * (days_saved * 0.022::DOUBLE))::BIGINT AS prevented_late_orders,
                   least(0.65::DOUBLE, days_saved * 0.08::DOUBLE + retention_points * 0.02::DOUBLE) AS csat_lift,
                   floor(total_orders * (retention_points / 100.0))::BIGINT AS additional_repeat_orders
            FROM swept)
        SELECT *, floor(prevented_late_orders * 0.58::DOUBLE)::BIGINT AS prevented_1_stars,
               additional_repeat_orders * aov * 1.35::DOUBLE AS projected_revenue_gain,
               {pct('additional_repeat_orders * aov * 1.35::DOUBLE', 'total_revenue')} AS gain_pct
        FROM effect""",
)


def for_levels(statement: str) -> str:
    """A statement on series of states as one on the series of all levels."""
    names = {"customer_state": "series", "lines": "level_lines", "state_months": "level_months"}
    return re.sub(r"\b(customer_state|lines|state_months)\b", lambda m: names[m.group()], statement)


_SCENARIOS = for_levels(ORACLES["ts_scenarios"])
add(
    **{
        f"ts_levels_{name}": for_levels(ORACLES[f"ts_{source}"])
        for name, source in {
            "monthly": "monthly",
            "fit": "damped_fit",
            "backtest": "backtest",
            "forecast": "forecast_all",
            "quarter_growth": "quarter_growth",
            "scenarios": "scenarios",
        }.items()
    },
    fmt_scenarios=for_levels(ORACLES["fmt_forecast"])
    .replace("SELECT series, ds AS", "SELECT series, scenario, ds AS", 1)
    .replace(f"({for_levels(ALL_AHEAD)})", f"({_SCENARIOS})"),
)
