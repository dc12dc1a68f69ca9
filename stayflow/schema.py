"""The customer-by-month panel: columns, arms, levels and ranges."""

from __future__ import annotations

# Treatment arms with their face cost and the share that redeems.
ARM_NAMES = ("control", "discount_10", "discount_25", "concierge")
ARM_COSTS = (0.0, 12.0, 30.0, 55.0)
ARM_REDEMPTION = (0.0, 0.62, 0.71, 0.48)

# Panel columns with their Spark types, by block.
ID_COLUMNS = {"customer_id": "string", "period": "bigint", "as_of_date": "timestamp", "cohort": "string", "split": "string", "assignment_block": "string"}
TREATMENT_COLUMNS = {"arm": "bigint", "treated": "bigint", "offer_cost": "double"}
NUMERIC_FEATURES = (
    "tenure_months", "recency_days", "frequency_12m", "monetary_12m", "avg_order_value", "n_categories_12m", "sessions_30d",
    "days_since_last_session", "engagement_score", "support_tickets_90d", "nps", "payment_failures_12m", "discount_depth_hist",
    "price_change_pct", "competitor_promo_intensity", "seasonality_index", "basket_diversity",
)
CATEGORICAL_LEVELS = {
    "plan_tier": ("basic", "plus", "pro", "enterprise"),
    "channel": ("organic", "paid", "referral", "partner"),
    "region": ("north", "south", "east", "west"),
    "device": ("ios", "android", "web"),
    "is_autopay": ("yes", "no"),
    "contract_type": ("monthly", "annual"),
}
OUTCOME_COLUMNS = {"churn_next": "bigint", "event_time": "double", "event_observed": "bigint", "rmst_h": "double", "value_h": "double", "margin_rate": "double"}

# Numbers outside these bounds are corrupt and are set to the bound.
PLAUSIBLE_RANGES = {
    "tenure_months": (0.0, 600.0),
    "recency_days": (0.0, 3650.0),
    "frequency_12m": (0.0, 1000.0),
    "monetary_12m": (0.0, 500000.0),
    "avg_order_value": (0.0, 50000.0),
    "n_categories_12m": (0.0, 100.0),
    "sessions_30d": (0.0, 3000.0),
    "days_since_last_session": (0.0, 3650.0),
    "engagement_score": (-10.0, 100.0),
    "support_tickets_90d": (0.0, 200.0),
    "nps": (-100.0, 100.0),
    "payment_failures_12m": (0.0, 100.0),
    "discount_depth_hist": (0.0, 5.0),
    "price_change_pct": (-100.0, 100.0),
    "competitor_promo_intensity": (-5.0, 100.0),
    "seasonality_index": (-5.0, 10.0),
    "basket_diversity": (0.0, 50.0),
}

PANEL = ID_COLUMNS | TREATMENT_COLUMNS | dict.fromkeys(NUMERIC_FEATURES, "double") | dict.fromkeys(CATEGORICAL_LEVELS, "string") | OUTCOME_COLUMNS

# Other spellings of categories, after normalisation.
SYNONYMS = {
    "plan_tier": {"ent": "enterprise", "enterprise_plus": "enterprise", "basic_v2": "basic", "premium": "pro", "tier_1": "basic"},
    "channel": {"seo": "organic", "organic_search": "organic", "ppc": "paid", "cpc": "paid", "sem": "paid", "affiliate": "partner", "word_of_mouth": "referral", "refer_a_friend": "referral"},
    "region": {"n": "north", "nth": "north", "s": "south", "e": "east", "w": "west", "northern": "north"},
    "device": {"apple": "ios", "iphone": "ios", "ipad": "ios", "ios_app": "ios", "droid": "android", "google_play": "android", "browser": "web", "desktop": "web"},
    "is_autopay": {"y": "yes", "true": "yes", "1": "yes", "t": "yes", "n": "no", "false": "no", "0": "no", "f": "no"},
    "contract_type": {"mo": "monthly", "month": "monthly", "m2m": "monthly", "yearly": "annual", "year": "annual", "12m": "annual", "anual": "annual"},
}
