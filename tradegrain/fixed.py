"""Labels, thresholds and texts that results must carry unchanged."""

# Delivery delay buckets (delay in days, upper bound inclusive).
DELAY_BUCKETS = [
    "Early (>3 days)",
    "On-Time (0-3 days early)",
    "Slight Delay (1-3 days late)",
    "Moderate Delay (4-7 days late)",
    "Severe Delay (>7 days late)",
]

# Delay tiers of the named query on reviews.
DELAY_TIERS = [
    "1. Early (> 3 Days)",
    "2. On-Time (0-3 Days Early)",
    "3. Minor Delay (1-3 Days Late)",
    "4. Moderate Delay (4-7 Days Late)",
    "5. Severe Delay (> 7 Days Late)",
]

# Upper bounds shared by both lists above; the last bucket is open.
DELAY_BOUNDS = [-3, 0, 3, 7]

# Expectation-gap bins and their inclusive upper bounds.
GAP_BINS = [
    "Early (-5d+)",
    "On-Time (-5d to 0d)",
    "Mild Delay (+1 to +3d)",
    "Moderate Delay (+4 to +7d)",
    "Severe Delay (+8d+)",
]
GAP_BOUNDS = [-5, 0, 3, 7]

# The playbook per customer segment.
PLAYBOOK = {
    "Champions": "VIP loyalty perks, early access to new lines, ambassador referrals.",
    "Loyal Customers": "Upsell premium bundles, personalized category recommendations.",
    "Potential Loyalists": "Offer membership incentives, engage with post-purchase rewards.",
    "Recent Buyers": "Provide high-touch onboarding, trigger second-purchase discount in 14 days.",
    "At Risk": "Aggressive win-back campaigns, limited-time renewal coupons, feedback survey.",
    "Cant Lose Them": "Direct outreach, premium concierge support, high-value retention voucher.",
    "Hibernating": "Low-cost email drip re-engagement campaigns, seasonal flash clearance.",
    "Lost / Inactive": "Exclude from high-cost ad targeting; seasonal reactivation attempts only.",
}
PLAYBOOK_DEFAULT = "Standard engagement"

# What a missing optional table or dimension is replaced with.
DEFAULT_PAYMENT_TYPE = "credit_card"
DEFAULT_INSTALLMENTS = 1
DEFAULT_REVIEW_SCORE = 4.0
DEFAULT_CATEGORY = "Other"
DEFAULT_CATALOG = "General Merchandise"
DEFAULT_WEIGHT_G = 1500.0
DEFAULT_VOLUME_CM3 = 8000.0
DEFAULT_DIMENSIONS_CM = {"length": 25.0, "height": 15.0, "width": 20.0}

# The home state of the "interstate" flag on the master table.
HOME_STATE = "SP"

# Decision thresholds, boosting rounds and step sizes per model.
MODEL_SETTINGS = {
    "repeat": {"threshold": 0.35, "rounds": 120, "step": 0.06},
    "delay": {"threshold": 0.40, "rounds": 110, "step": 0.08},
    "csat": {"threshold": 0.45, "rounds": 100, "step": 0.07},
    "delay_normalized": {"threshold": 0.50, "rounds": 100, "step": 0.08},
}

# Propensity and risk tiers, cut-offs inclusive, highest first.
REPEAT_TIERS = [
    (0.60, "HIGH PROPENSITY (Potential Loyalist)"),
    (0.30, "MODERATE CONVERSION RISK (Needs Nudge)"),
    (None, "HIGH CHURN RISK (One-and-Done Buyer)"),
]
REPEAT_CALIBRATION = 1.6
DELAY_RISK_TIERS = [
    (0.50, "CRITICAL SLA RISK"),
    (0.25, "MODERATE DELAY RISK"),
    (None, "OPTIMAL ON-TIME ROUTE"),
]
CSAT_RISK_TIERS = [
    (0.60, "CRITICAL CSAT THREAT (High 1-Star Probability)"),
    (0.30, "MODERATE DISSATISFACTION RISK"),
    (None, "HEALTHY CUSTOMER EXPERIENCE (Expected 4-5 ⭐)"),
]
ORDER_RISK_TIERS = [(0.55, "Critical Risk"), (0.28, "Moderate Risk"), (None, "Low Risk")]
ORDER_RISK_NOTES = [
    (0.55, "High likelihood of 1-Star Review (~78% historic correlation with late deliveries)"),
    (0.28, "Moderate risk of review score degradation (Expect 2-3 Stars)"),
    (None, "High likelihood of positive CSAT (~92% historic 4-5 Star reviews)"),
]

# Recommendation texts of the order risk report.
ADVICE_ROUTING = (
    "📍 **Regional Routing:** Re-route package through a local cross-dock center "
    "to eliminate interstate transfer choke-points."
)
ADVICE_SLA = (
    "⏱️ **SLA Realignment:** Estimated delivery window is too aggressive for this postal "
    "corridor. Extend customer SLA by +2 days."
)
ADVICE_HEAVY = (
    "📦 **Heavy Freight Protocol:** Switch from standard postal carrier to specialized road "
    "logistics partner for heavy items (>6kg)."
)
ADVICE_DEFAULT = (
    "✅ **Optimal Fulfillment:** Logistics parameters are well-balanced; automated carrier "
    "dispatch recommended."
)

# Readable feature names of the order delay model.
FEATURE_NAMES = {
    "estimated_days": "Carrier SLA (Estimated Days)",
    "freight_ratio": "Freight-to-Price Ratio",
    "is_interstate": "Interstate Shipping Flag",
    "freight_value": "Freight Cost (R$)",
    "product_weight_g": "Product Weight (g)",
    "product_volume_cm3": "Product Volume (cm³)",
    "price": "Item Price (R$)",
    "purchase_month": "Seasonal Month",
    "purchase_dayofweek": "Day of Week",
}

# Forecast bands, fallback growth and scenario multipliers.
BAND_Z = {"80": 1.28, "95": 1.96}
FALLBACK_GROWTH = {
    "short_series": [1.02, 1.05, 1.08, 1.16, 1.25, 1.12],
    "failed_fit": [1.02, 1.05, 1.08, 1.15, 1.22, 1.10],
}
FALLBACK_BANDS = {"80": (0.92, 1.08), "95": (0.85, 1.15)}
SCENARIOS = [("Baseline", 1.0), ("Optimistic", 1.10), ("Conservative", 0.90)]
GROWTH_WITHOUT_BASE = 12.5

# The observed month window of the forecast.
FORECAST_FIRST_MONTH = "2017-01"
FORECAST_LAST_MONTH = "2018-08"
