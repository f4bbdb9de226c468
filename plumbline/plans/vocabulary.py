"""Words that speak for a business domain, in column names, bound roles and values."""

# Domain -> part of a column's name -> points.
NAME_POINTS: dict[str, dict[str, float]] = {
    "sales": {"revenue": 3.0, "sales": 3.0, "order": 2.5, "quantity": 2.0, "discount": 2.0, "profit": 2.0, "customer": 1.5, "product": 1.5, "region": 1.5, "sales_rep": 2.5, "pipeline": 2.0, "deal": 2.0, "quota": 2.5, "unit_price": 2.0},
    "marketing": {"campaign": 3.5, "impressions": 3.5, "clicks": 3.5, "ctr": 3.5, "cpc": 3.0, "cpa": 3.0, "roas": 3.5, "ad_spend": 3.0, "conversions": 2.5, "channel": 2.0, "utm": 3.0, "creative": 2.5, "audience": 2.0, "reach": 2.0, "lead": 2.0},
    "finance": {"expense": 3.0, "budget": 2.5, "gl_account": 3.5, "ledger": 3.5, "cash_flow": 3.5, "ebitda": 3.5, "opex": 3.0, "capex": 3.0, "accrual": 3.0, "cost_center": 3.5, "fiscal": 2.5, "invoice": 2.0, "payable": 3.0, "receivable": 3.0, "margin": 2.0},
    "banking": {"transaction": 2.5, "merchant": 3.0, "card": 3.0, "account_balance": 3.0, "credit_limit": 3.5, "fraud": 3.5, "chargeback": 3.5, "mcc": 3.5, "swipe": 3.0, "atm": 3.0, "interchange": 3.5, "cardholder": 3.5, "authorization": 3.0, "delinquency": 3.5, "loan": 2.5, "interest_rate": 2.5, "branch": 2.0},
    "ecommerce": {"cart": 3.5, "checkout": 3.5, "sku": 2.5, "basket": 3.0, "shipping": 2.5, "delivery": 2.0, "return": 2.0, "wishlist": 3.0, "session": 2.0, "browse": 2.5, "coupon": 2.5, "fulfilment": 2.5, "fulfillment": 2.5, "marketplace": 2.5},
    "hr": {"employee": 3.5, "salary": 3.0, "attrition": 3.5, "hire": 3.0, "termination": 3.5, "department": 2.0, "manager": 2.0, "performance_rating": 3.0, "tenure": 3.0, "headcount": 3.5, "recruit": 3.0, "leave": 2.0, "payroll": 3.5, "promotion": 2.5},
    "healthcare": {"patient": 3.5, "diagnosis": 3.5, "admission": 3.0, "discharge": 3.0, "readmission": 3.5, "icd": 3.5, "procedure": 2.5, "provider": 2.5, "claim": 2.5, "length_of_stay": 3.5, "ward": 3.0, "physician": 3.5, "treatment": 3.0},
    "manufacturing": {"production": 3.0, "defect": 3.5, "yield": 3.0, "downtime": 3.5, "machine": 3.0, "batch": 2.5, "shift": 2.5, "scrap": 3.5, "oee": 3.5, "throughput": 3.0, "plant": 2.5, "line": 1.5, "maintenance": 2.5, "cycle_time": 3.0},
    "supply_chain": {"inventory": 3.5, "warehouse": 3.0, "stock": 2.5, "supplier": 3.0, "lead_time": 3.0, "shipment": 3.0, "logistics": 3.0, "backorder": 3.5, "reorder": 3.0, "fill_rate": 3.5, "freight": 3.0, "carrier": 2.5},
    "saas": {"mrr": 3.5, "arr": 3.5, "subscription": 3.5, "churn": 3.0, "trial": 3.0, "seat": 2.5, "plan": 2.0, "renewal": 3.0, "activation": 2.5, "dau": 3.5, "mau": 3.5, "feature_usage": 3.0, "onboarding": 2.5},
}
# Domain -> bound role -> points.
ROLE_POINTS: dict[str, dict[str, float]] = {
    "sales": {"revenue": 2.0, "quantity": 1.5, "order_id": 1.5, "product_id": 1.0},
    "marketing": {"impressions": 3.0, "clicks": 3.0, "campaign_id": 2.5, "marketing_spend": 2.0, "conversions": 1.5},
    "finance": {"cost": 2.0, "profit": 2.0, "revenue": 0.5},
    "banking": {"merchant_id": 3.0, "fraud_flag": 3.0, "order_id": 0.5},
    "ecommerce": {"return_flag": 2.0, "sessions": 1.5, "product_id": 1.0},
    "hr": {"employee_id": 3.0, "salary": 3.0, "tenure": 2.0, "churn_flag": 1.0},
    "healthcare": {"length_of_stay": 3.0, "readmission_flag": 3.0},
    "manufacturing": {"defect_flag": 3.0, "downtime": 3.0, "output": 2.0},
    "saas": {"churn_flag": 2.0},
}
# Domain -> parts of values of text columns, each VALUE_POINTS where any value holds it.
VALUE_POINTS = 1.5
VALUES: dict[str, tuple[str, ...]] = {
    "banking": ("debit", "credit", "atm", "pos", "wire", "upi", "ach", "visa", "mastercard", "chargeback", "declined", "authorized"),
    "marketing": ("google ads", "meta", "facebook", "instagram", "email", "display", "search", "affiliate", "programmatic"),
    "ecommerce": ("delivered", "shipped", "returned", "cart", "checkout", "cod"),
    "hr": ("resigned", "terminated", "promoted", "full-time", "part-time", "intern"),
    "healthcare": ("inpatient", "outpatient", "emergency", "icu", "discharged"),
    "manufacturing": ("shift a", "shift b", "night shift", "scrap", "rework"),
    "saas": ("trial", "monthly", "annual", "enterprise plan", "freemium"),
}
# Fixed values of the SQL profile: words in column names (any of a row's), the domain they speak for, and points.
SQL_NAME_POINTS: tuple[tuple[str, str, int], ...] = (
    ("merchant|mcc|card|atm|branch|interchange|chargeback|fraud|balance|iban", "banking", 3),
    ("impression|click|ctr|cpa|roas|campaign|ad_group|creative|spend", "marketing", 3),
    ("basket|cart|sku|checkout|order_id|shipping|coupon|gmv", "ecommerce", 3),
    ("patient|admission|readmission|diagnosis|icd|ward|clinician|length_of_stay|los", "healthcare", 4),
    ("employee|attrition|headcount|tenure|payroll|manager|hire_date|salary", "hr", 4),
    ("machine|line|shift|downtime|defect|scrap|oee|throughput|yield", "manufacturing", 4),
    ("gl_account|ledger|ebitda|cash_flow|opex|capex|accrual|cost_centre|cost_center", "finance", 3),
    ("supplier|warehouse|inventory|lead_time|stockout|freight|shipment", "supply_chain", 3),
    ("mrr|arr|subscription|seat|trial|churn|plan_tier", "saas", 3),
    ("quota|pipeline|opportunity|rep|territory|deal|store|category|units_sold", "sales", 2),
    ("revenue|profit|margin|customer|product|region", "sales", 1),
)
# Fixed values of the SQL profile: words in column names that tell a measure's kind, and keys.
MONEY = "revenue|sales|amount|price|cost|spend|value|profit|margin|fee|balance|payment|charge|salary|budget|gmv|aov|arpu|income|expense|claim|premium|wage"
PERCENT = "pct|percent|rate|ratio|share|_pp$|utilisation|utilization|occupancy"
COUNT = "count|qty|quantity|units|visits|sessions|clicks|impressions|orders|tickets|calls|logins|views|transactions"
KEY = "^id$|_id$|^id_|uuid|guid|code$|number$|_no$|_key$|account|customer|member|patient|employee|merchant|invoice|transaction_id"
