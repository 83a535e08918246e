"""Lookup tables and word lists of the order-cleaning rules.

Fixed values: these must equal the rules of the source pipeline for identical
results. They are stated plainly, in their natural order, and are turned into
tiny DataFrames (broadcast joins, size bounded by these literals) by
``lookup_df``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ----------------------------------------------------------------------------
# US state name -> two-letter code (52 entries).
STATE_CODES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA",
    "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA",
    "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS",
    "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA",
    "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT",
    "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM",
    "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK",
    "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC",
    "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT",
    "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
    "district of columbia": "DC", "dc": "DC",
}

# Bundle SKU -> component SKUs (17 bundles).
BUNDLES = {
    "BSH10E-1000": ["B10-1000", "SH10E-1000"],
    "BSH10-1000": ["B10-1000", "SH10-1000"],
    "CSH6E-1000-1": ["N6-1000", "SH6E-1000"],
    "CSH6E-1000": ["C6-1000", "SH6E-1000"],
    "CSH6-1000": ["C6-1000", "SH6-1000"],
    "CSH8E-1000": ["C8-1000", "SH8E-1000"],
    "CSH8-1000": ["C8-1000", "SH8-1000"],
    "NSH6-1000": ["N6-1000", "SHN6-1000"],
    "PSH4E-1000": ["P4-1000", "SH4E-1000"],
    "PSH4-1000": ["P4-1000", "SH4-1000"],
    "SSH10E-1000": ["S10-1000", "SH10E-1000"],
    "SSH10-1000": ["S10-1000", "SH10-1000"],
    "ES3-1000": ["C8-1000", "P4-1000", "B10-1000"],
    "ESH3-1000": ["C8-1000", "P4-1000", "B10-1000", "SH8-1000", "SH4-1000", "SH10-1000"],
    "FF7-1000": ["C8-1000", "C6-1000", "B10-1000", "S10-1000", "P4-1000", "KB1-1000", "CK2-1000"],
    "FF8-1000": ["C8-1000", "C6-1000", "B10-1000", "S10-1000", "P4-1000", "N6-1000", "KB1-1000",
                 "CK2-1000"],
    "SS2-1000": ["C8-1000", "P4-1000"],
}

# SKUs kept after bundle expansion (27, "nan" = item without SKU).
SKU_WHITELIST = [
    "B10-1000", "C6-1000", "C8-1000", "N6-1000", "P4-1000", "S10-1000",
    "HR12-1000", "SH10-1000", "SH8-1000", "SH6-1000", "SH4-1000",
    "SHN6-1000", "SH10E-1000", "SH6E-1000", "SH8E-1000", "SH4E-1000",
    "CK2-1000", "EVT-1000", "SS0-1000", "KB1-1000", "KS0-1000",
    "nan", "DH-1000", "DS-M", "DS-L", "FFS-1000", "EB5-1000",
]

# SKU -> product category (17 SKUs, 4 categories).
SKU_CATEGORIES = {
    "C6-1000": "Chef Knife", "C8-1000": "Chef Knife",
    "B10-1000": "Specialty Knife", "N6-1000": "Specialty Knife", "P4-1000": "Specialty Knife",
    "S10-1000": "Specialty Knife",
    "HR12-1000": "Honing Rod",
    "SH10-1000": "Sheath", "SH8-1000": "Sheath", "SH6-1000": "Sheath",
    "SH4-1000": "Sheath", "SHN6-1000": "Sheath",
    "SH10E-1000": "Sheath", "SH6E-1000": "Sheath", "SH8E-1000": "Sheath",
    "SHN6E-1000": "Sheath", "SH4E-1000": "Sheath",
}

# SKU count columns left out of the next-product models (21).
UNWANTED_SKUS = [
    "CK2-1000", "EVT-1000", "SS0-1000", "KB1-1000", "KS0-1000", "nan",
    "SH10-1000", "SH8-1000", "SH6-1000", "SH4-1000", "SHN6-1000",
    "SH10E-1000", "SH6E-1000", "SH8E-1000", "SHN6E-1000", "SH4E-1000",
    "DS-M", "DS-L", "EB5-1000", "FFS-1000", "DH-1000",
]

# SKU count columns left out of the category model (11).
UNWANTED_SKUS_CATEGORY = [
    "CK2-1000", "EVT-1000", "SS0-1000", "KB1-1000", "KS0-1000", "nan",
    "DS-M", "DS-L", "EB5-1000", "FFS-1000", "DH-1000",
]

# E-mail hosts counted as personal.
PERSONAL_EMAIL_HOSTS = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "live.com",
                        "aol.com", "icloud.com"]
EDUCATION_SUFFIXES = [".edu"]
CORPORATE_SUFFIXES = [".com", ".net", ".org"]

# Company texts meaning "no company" (compared trimmed, lower case).
COMPANY_UNKNOWN_WORDS = ["unknown", "", "optional", "title (optional)"]
COMPANY_RETIRED_WORDS = ["retired"]
COMPANY_PERSONAL_WORDS = ["guest", "self employed"]

# Census symbols; income estimates lose these characters, margins
# with one of these whole values are "not available".
INCOME_STRIP_PATTERN = r"[,+\-N]"
MARGIN_NULL_SYMBOLS = ["***", "**", "-", "N"]
CENSORED_MARGIN = "***"

# The score above which a customer is predicted to return.
RETURN_THRESHOLD = 0.3773

# Categorical columns that are one-hot encoded.
ONE_HOT_COLUMNS = [
    "order_currency", "payment_method", "shipping_method",
    "billing_state", "billing_country",
    "shipping_state", "shipping_country",
    "billing_zip_main", "shipping_zip_main",
    "email_domain", "email_category",
    "phone_area_code", "most_frequent_product", "billing_company_category",
]

#: Of these, the columns whose values grow with the number of customers.
OPEN_ENDED_COLUMNS = ("billing_zip_main", "shipping_zip_main", "email_domain", "phone_area_code")

# The column after which the saved training table lists features.
FEATURE_MARKER = "repeat_purchase_amount"

# Columns never given to a model (raw time parts, cities, labels).
MODEL_DROP_COLUMNS = [
    "person_id", "order_datetime", "repeat_purchase_amount", "billing_city", "shipping_city",
    "order_day", "order_month", "order_hour", "order_minute",
    "billing_city_frequency", "shipping_city_frequency", "repeat_customer",
]


def lookup_df(spark: SparkSession, mapping: dict, key: str, value: str) -> DataFrame:
    """A two-column DataFrame from a literal mapping; list values become one row each.

    It is an inline table, whose size the planner knows (rows handed over from Python
    have none, and would be joined by a shuffle).
    """
    pairs = [(k, item) for k, v in mapping.items() for item in (v if isinstance(v, list) else [v])]
    if not pairs:
        return spark.sql(f"SELECT CAST(NULL AS STRING) AS `{key}`, CAST(NULL AS STRING) AS `{value}` WHERE false")
    rows = ", ".join(f"(:k{i}, :v{i})" for i in range(len(pairs)))
    args = {f"{c}{i}": text for i, pair in enumerate(pairs) for c, text in zip("kv", pair, strict=True)}
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(`{key}`, `{value}`)", args=args)
