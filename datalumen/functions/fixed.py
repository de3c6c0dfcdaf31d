"""Word lists, patterns, weights and thresholds that decide results."""

# Strings that stand for a missing value (compared after trim and lower).
PLACEHOLDERS = ["", "null", "none", "na", "n/a", "nan", "missing", "unknown", "?", "-", "."]

# Personal-data patterns, in the order in which the first hit names the column.
PII_PATTERNS = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"(\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b(?:\d[ -]*?){13,16}\b",
}
PII_RATE = 0.4

# Role inference.
BOOLEAN_WORDS = ["true", "false", "1", "0", "yes", "no", "y", "n", "t", "f"]
ID_SUFFIXES = ["_id", "id", "code", "key", "num", "no"]
TARGET_NAMES = [
    "target", "label", "outcome", "churn", "is_churn", "fraud",
    "sales", "revenue", "spend", "spend_amount", "spend_total",
]
FLAG_PREFIXES = ["is_", "has_", "flag_"]
DATE_RATE = 0.8
NUMBER_RATE = 0.85
CONVERT_RATE = 0.75
CATEGORY_RATIO = 0.3
CATEGORY_LEVELS = 50
HIGH_CARDINALITY_PCT = 80

# Date layouts accepted in text columns besides ISO dates and times.
SLASH_FORMATS = ["yyyy/MM/dd", "MM/dd/yyyy"]

# Label spellings for columns whose name holds one of the words.
LABEL_COLUMNS = ["gender", "sex"]
LABEL_MAP = {"F": "Female", "FEMALE": "Female", "M": "Male", "MALE": "Male"}

# Names by which the business roles are found, first schema column wins.
REVENUE_NAMES = ["spend", "total_spend", "revenue", "sales", "price", "amount", "total_amount"]
UNITS_NAMES = ["units", "units_sold", "quantity", "qty"]
CUSTOMER_NAMES = ["customer_id", "cust_id", "user_id", "client_id"]
RETURN_NAMES = ["is_returned", "returned", "return_flag", "is_defective", "churn"]
RETURN_YES = ["yes", "true", "1"]

# Terms that ask for outside research.
RESEARCH_TERMS = [
    "benchmark", "industry", "market trend", "market", "competitor", "external", "benchmarking",
    "industry standard", "best practice", "research", "sector", "web", "public data",
]

# Keyword weights per business domain, matched inside column names.
DOMAIN_KEYWORDS = {
    "E-Commerce & Retail": {
        "order": 3, "product": 3, "revenue": 3, "sale": 3, "purchase": 3,
        "cart": 3, "checkout": 3, "sku": 3, "price": 2, "discount": 2,
        "coupon": 2, "return": 2, "refund": 2, "category": 1, "brand": 2,
        "inventory": 2, "stock": 2, "customer": 1, "aov": 3, "ltv": 3,
        "basket": 3, "shipping": 2, "delivery": 2, "retailer": 3,
    },
    "Finance & Banking": {
        "transaction": 3, "account": 3, "balance": 3, "credit": 3, "debit": 3,
        "loan": 3, "interest": 3, "fraud": 3, "payment": 2, "bank": 3,
        "risk": 2, "default": 3, "portfolio": 3, "asset": 2, "liability": 2,
        "income": 2, "expense": 2, "claim": 2, "premium": 2, "policy": 2,
        "investment": 3, "return_rate": 3, "apr": 3, "mortgage": 3,
    },
    "Healthcare & Clinical": {
        "patient": 3, "diagnosis": 3, "medication": 3, "treatment": 3,
        "hospital": 3, "clinical": 3, "disease": 3, "symptom": 3,
        "icd": 3, "cpt": 3, "readmission": 3, "mortality": 3,
        "age": 1, "gender": 1, "bmi": 3, "blood": 2, "pressure": 2,
        "glucose": 2, "cholesterol": 2, "lab": 2, "test": 1,
        "outcome": 2, "survival": 3, "comorbidity": 3,
    },
    "Human Resources & HR": {
        "employee": 3, "salary": 3, "attrition": 3, "department": 2,
        "hire": 3, "termination": 3, "performance": 2, "rating": 2,
        "tenure": 3, "headcount": 3, "payroll": 3, "workforce": 3,
        "job": 2, "role": 2, "level": 1, "manager": 2, "engagement": 2,
        "satisfaction": 2, "promotion": 3, "training": 2, "absenteeism": 3,
    },
    "Marketing & CRM": {
        "lead": 3, "campaign": 3, "conversion": 3, "click": 3, "impression": 3,
        "ctr": 3, "roas": 3, "cpa": 3, "email": 2, "open_rate": 3,
        "segment": 2, "engagement": 2, "subscriber": 3, "unsubscribe": 3,
        "channel": 2, "acquisition": 2, "funnel": 3, "pipeline": 2,
        "opportunity": 2, "marketing": 3, "advertisement": 2, "ad": 2,
    },
    "Operations & Logistics": {
        "shipment": 3, "delivery": 3, "warehouse": 3, "inventory": 3,
        "lead_time": 3, "supplier": 3, "purchase_order": 3, "sku": 2,
        "dispatch": 3, "logistics": 3, "route": 3, "fleet": 3,
        "defect": 3, "quality": 2, "sla": 3, "on_time": 3, "delay": 3,
        "capacity": 2, "throughput": 3, "cycle_time": 3, "oee": 3,
    },
}
GENERAL_DOMAIN = "General / Mixed"
CONFIDENCE_LEVELS = [(15, "High"), (7, "Medium"), (3, "Low")]
