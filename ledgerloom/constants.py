"""Domains and settings of the transaction ledger.

Everything in this module is a fixed value: word lists, lookup tables and
default thresholds that results depend on. They are kept in their natural
order and in one place.
"""

# --- fixed values: enumerations -------------------------------------------
TYPES = [
    "CASH_IN",
    "CASH_OUT",
    "DEBIT",
    "PAYMENT",
    "SALARY",
    "SHOP",
    "SUBSCRIPTION",
    "TRANSFER",
]
CREDIT_TYPES = ["SALARY", "CASH_IN"]
DUPLICATE_TYPES = ["SHOP", "PAYMENT", "SUBSCRIPTION", "DEBIT"]
RECURRING_TYPES = ["SHOP", "PAYMENT", "SUBSCRIPTION", "TRANSFER"]
SPENDING_CATEGORIES = [
    "groceries",
    "dining",
    "transport",
    "utilities",
    "entertainment",
    "shopping",
    "health",
    "subscriptions",
]
ACCOUNT_TYPES = ["checking", "savings", "credit", "background"]
PERSONA_ARCHETYPES = [
    "young_professional",
    "dual_income_family",
    "gig_worker",
    "retiree",
    "recent_graduate",
    "small_business_owner",
]
FRAUD_ARCHETYPES = [
    "balance_drain",
    "duplicate_charge",
    "spend_spike",
    "card_testing",
    "slow_balance_drain",
    "new_payee_transfer",
    "subscription_creep",
    "refund_abuse",
    "mimicry",
    "account_takeover",
    "bust_out",
    "seasonal_mimicry",
]
HARD_NEGATIVES = [
    "hard_negative_life_event",
    "hard_negative_travel",
    "hard_negative_rapid_burst",
]

# --- fixed values: regions (city, state, latitude, longitude) --------------
# region id = R<two-digit position>_<city in lower case without spaces>
REGIONS = [
    ("Portland", "OR", 45.52, -122.68),
    ("Austin", "TX", 30.27, -97.74),
    ("Denver", "CO", 39.74, -104.99),
    ("Seattle", "WA", 47.61, -122.33),
    ("Minneapolis", "MN", 44.98, -93.27),
    ("Nashville", "TN", 36.16, -86.78),
    ("Charlotte", "NC", 35.23, -80.84),
    ("Columbus", "OH", 39.96, -83.00),
    ("Indianapolis", "IN", 39.77, -86.16),
    ("San Antonio", "TX", 29.42, -98.49),
    ("Sacramento", "CA", 38.58, -121.49),
    ("Raleigh", "NC", 35.78, -78.64),
    ("Milwaukee", "WI", 43.04, -87.91),
    ("Kansas City", "MO", 39.10, -94.58),
    ("Salt Lake City", "UT", 40.76, -111.89),
    ("Tucson", "AZ", 32.22, -110.97),
    ("New Orleans", "LA", 29.95, -90.07),
    ("Louisville", "KY", 38.25, -85.76),
    ("Oklahoma City", "OK", 35.47, -97.52),
    ("Buffalo", "NY", 42.89, -78.88),
    ("Omaha", "NE", 41.26, -95.93),
    ("Albuquerque", "NM", 35.08, -106.65),
    ("El Paso", "TX", 31.76, -106.49),
    ("Fresno", "CA", 36.74, -119.77),
    ("Grand Rapids", "MI", 42.96, -85.66),
    ("Knoxville", "TN", 35.96, -83.92),
    ("Spokane", "WA", 47.66, -117.43),
    ("Boise", "ID", 43.62, -116.20),
    ("Madison", "WI", 43.07, -89.40),
    ("Richmond", "VA", 37.54, -77.44),
    ("Providence", "RI", 41.82, -71.41),
    ("Hartford", "CT", 41.76, -72.67),
    ("Wilmington", "DE", 39.74, -75.55),
    ("Manchester", "NH", 42.99, -71.45),
    ("Burlington", "VT", 44.48, -73.21),
    ("Portland", "ME", 43.66, -70.25),
]
EARTH_RADIUS_MILES = 3958.8

# --- fixed values: category catalogue --------------------------------------
CATEGORY_GROUP = {
    "income": "income",
    "refund": "income",
    "housing": "fixed",
    "utilities": "fixed",
    "subscriptions": "fixed",
    "credit": "fixed",
    "groceries": "discretionary",
    "dining": "discretionary",
    "transport": "discretionary",
    "entertainment": "discretionary",
    "shopping": "discretionary",
    "health": "discretionary",
    "savings": "savings",
    "transfer": "transfer",
}
SUBCATEGORIES = {
    "dining": ["coffee_shops", "restaurants", "fast_food"],
    "groceries": ["supermarket", "warehouse", "convenience"],
    "shopping": ["online", "retail", "department_store", "home"],
    "transport": ["rideshare", "fuel", "transit", "parking"],
    "utilities": ["electricity", "water", "internet", "phone"],
    "entertainment": ["streaming", "cinema", "gaming", "events"],
    "health": ["pharmacy", "clinic", "gym"],
    "subscriptions": ["streaming", "software", "fitness"],
    "housing": ["rent", "mortgage"],
    "income": ["payroll", "freelance", "pension", "deposit"],
    "savings": ["auto_transfer"],
    "transfer": ["p2p", "wire", "atm", "internal"],
    "refund": ["merchant_refund"],
    "credit": ["credit_payment"],
}
# spend multiplier per month, January first; other categories are flat at 1.0
SEASONAL = {
    "groceries": [1.05, 1.0, 1.0, 1.0, 1.0, 1.0, 1.05, 1.1, 1.05, 1.1, 1.2, 1.3],
    "dining": [0.65, 0.9, 1.0, 1.0, 1.05, 1.0, 1.05, 1.0, 1.05, 1.1, 1.2, 1.35],
    "transport": [0.9, 0.95, 1.0, 1.0, 1.05, 1.1, 1.2, 1.15, 1.05, 1.0, 1.1, 1.2],
    "utilities": [1.35, 1.25, 1.05, 0.9, 0.85, 0.9, 1.05, 1.25, 1.15, 0.95, 1.05, 1.2],
    "entertainment": [0.9, 0.95, 1.0, 1.0, 1.05, 1.1, 1.2, 1.05, 1.0, 1.0, 1.1, 1.3],
    "shopping": [0.85, 0.9, 0.95, 1.0, 1.05, 1.0, 1.05, 1.2, 1.05, 1.1, 1.5, 1.7],
    "health": [1.1, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.05, 1.05, 1.1],
}

# --- fixed values: default thresholds and prices ---------------------------
BUDGETS = {
    "groceries": 700.0,
    "dining": 350.0,
    "transport": 150.0,
    "utilities": 150.0,
    "entertainment": 200.0,
    "shopping": 250.0,
    "health": 100.0,
    "subscriptions": 120.0,
}
# price tier -> (input, output) list price in dollars per million tokens
PRICING = {
    "standard": (3.0, 15.0),
    "premium": (15.0, 75.0),
    "fast": (0.8, 4.0),
    "mini": (0.25, 1.25),
}
DEFAULT_PRICE = (3.0, 15.0)
BLEND = {"rules": 0.4, "supervised": 0.3, "isolation_forest": 0.3}
FRAUD_THRESHOLD = 0.7
DUPLICATE_WINDOW_DAYS = 2
DRAIN_WINDOW_HOURS = 6
DRAIN_MIN_AMOUNT = 500.0
DRAIN_RATIO = 0.5
DRAIN_MATCH = 0.9
SPIKE_Z = 3.0
SCORE_DRAIN, SCORE_DUPLICATE, SCORE_SPIKE = 1.0, 0.8, 0.65
REASON_DRAIN = "Balance-draining transfer followed by cash-out"
REASON_DUPLICATE = "Duplicate charge: same merchant and amount within the window"
REASON_SPIKE = "Category spending spike above the usual baseline"
REASON_ISOLATION = "unusual pattern vs normal behaviour"
SAVINGS_RATE_GOAL = 0.20
SUBSCRIPTION_RATIO_LIMIT = 0.05
ALERT_ROW_CAP = 25
ALERT_FIELDS = [
    "row_index",
    "date",
    "merchant",
    "amount",
    "category",
    "type",
    "risk_score",
    "rule_score",
    "model_score",
    "reason",
    "fraud_archetype",
]
# route -> keywords; the route whose matched keywords are longest in total wins,
# the first listed on a tie, "summary" when nothing matches
ROUTES = [
    ("risk", ["suspicious", "fraud", "anomal", "scam", "risk", "flag", "alert"]),
    ("budget", ["budget", "goal", "on track", "over spending", "over-budget"]),
    ("save", ["save", "cut", "reduce", "tips", "spend less", "save more"]),
    ("forecast", ["forecast", "next month", "predict", "projection"]),
    (
        "category",
        ["category", "breakdown", "spent", "spending", "where did", "how much"]
        + SPENDING_CATEGORIES,
    ),
    ("recurring", ["recurring", "subscription", "subscriptions", "membership"]),
    ("health", ["health", "score", "healthy"]),
    ("similar", ["similar", "nearest"]),
    ("greeting", ["hello", "hi ", "hey", "who are you", "help", "what can"]),
]
GATED_ENDPOINTS = [
    "health",
    "meta",
    "monthly-summary",
    "category-breakdown",
    "budget-status",
    "recurring-payments",
    "spend-spikes",
    "financial-health",
    "forecast",
    "tips",
    "similar-transactions",
    "risk-scored",
]


def region_id(position: int) -> str:
    return f"R{position:02d}_{REGIONS[position][0].lower().replace(' ', '')}"
