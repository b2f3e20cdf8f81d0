"""Default rule tables. Every operator takes its rules as an argument; these are the defaults."""

from __future__ import annotations

# Roles, and the subsets of them that the rules name.
ROLES = ("vendor", "application", "service", "business_unit", "department", "cost_center", "cloud_resource", "cloud_provider", "infrastructure_asset", "project", "person", "cost_amount", "identifier", "date", "description", "other")
EMBEDDABLE_ROLES = ROLES[:10]
PAIRABLE_ROLES = ("vendor", "application", "project", "business_unit", "department", "cost_center")
UNRELATABLE_ROLES = ("cost_amount", "description", "other")
ANCHOR_ORDER = ("service", "application", "cloud_resource", "infrastructure_asset", "vendor", "cloud_provider", "project", "business_unit", "department", "cost_center")

# Words in headers that tell a table's source, in order of preference.
SOURCE_KEYWORDS = {
    "General Ledger": ("gl_account", "ledger", "journal", "debit", "credit"),
    "ERP": ("po_number", "purchase_order", "vendor_id", "erp"),
    "AWS Billing": ("aws", "ec2", "s3", "usagetype", "linkedaccountid"),
    "Azure Billing": ("azure", "subscriptionid", "resourcegroup"),
    "GCP Billing": ("gcp", "project_id", "sku_id", "billing_account"),
    "CMDB": ("cmdb", "configuration_item", "ci_id", "asset_tag"),
    "Cost Center Master": ("cost_center", "costcenter", "cc_code"),
    "Application Inventory": ("application_name", "app_id", "app_owner"),
    "HR Systems": ("employee_id", "hire_date", "department", "manager_id"),
    "Business Unit Mapping": ("business_unit", "bu_code", "bu_name"),
}

# Patterns of column names (lower case), the first that fits wins.
TECHNICAL_NAME = r"(^id$|_id$|uuid|guid|surrogate|_key$|^key$|row_hash|etl_)"
TIMESTAMP_NAME = r"(created_at|updated_at|_ts$|timestamp|load_date|etl_date)"
UUID_VALUE = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
ROLE_PATTERNS = (
    (r"vendor|supplier", "vendor"),
    (r"application|app_name|app_id", "application"),
    (r"service_name|service", "service"),
    (r"business_unit|bu_name|bu_code", "business_unit"),
    (r"department|dept", "department"),
    (r"cost_center|costcenter|cc_code", "cost_center"),
    (r"resource|instance|ec2|compute", "cloud_resource"),
    (r"owner|manager|employee_name|contact_name|approver", "person"),
    (r"debit|credit|amount|cost|price|spend", "cost_amount"),
    (r"date|_dt$", "date"),
    (r"description|desc$", "description"),
    (r"(^|_)(account|number|code|name)$", "identifier"),
)

# Names (without spaces, underscores and hyphens) whose role is certain.
ROLE_OVERRIDES = {
    "vendor": ("vendorname", "vendor", "vendorid", "supplier", "suppliername", "supplierid", "manufacturer"),
    "cost_center": ("costcenter", "costcentre", "costcentername"),
    "business_unit": ("businessunit", "bu", "buname"),
    "department": ("department", "departmentname", "departmentdescription"),
    "application": ("application", "applicationname", "app", "appconsumer"),
    "cloud_provider": ("cloudprovider", "cloudvendor", "csp"),
    "infrastructure_asset": ("storagedeviceid", "serverid", "assetid"),
    "project": ("projectid", "projectname"),
    "person": ("owner", "costcenterowner", "manager", "contact", "contactname", "createdby", "updatedby"),
    "identifier": ("journalid", "voucherid", "invoicenumber", "ponumber"),
}

# Labels of edges, by column name, by role, and by the roles of two values in one row.
EDGE_NAME_LABELS = (("manufacturer", "HAS_MANUFACTURER"), ("location", "LOCATED_IN"), ("platform", "USES_PLATFORM"))
PAIR_LABELS = (("cost_center", "vendor", "USES_VENDOR"), ("department", "vendor", "USES_VENDOR"), ("project", "vendor", "CONTRACTED_WITH"), ("application", "cloud_provider", "HOSTED_BY"), ("infrastructure_asset", "vendor", "MANUFACTURED_BY"))
DOMAINS = (("storage", "Storage Domain"), ("cost|finance|gl|ledger|account", "Finance Domain"), ("hr|employee|payroll", "HR Domain"), ("aws|azure|gcp|cloud", "Cloud Domain"), ("app", "Application Domain"))
INTERNAL_TYPES = ("dataset", "attribute_group", "taxonomy_category")

# Currency codes, and what stands for some of them.
CURRENCIES = ("USD", "EUR", "GBP", "JPY", "CNY", "INR", "CAD", "AUD", "CHF", "NZD", "HKD", "SGD", "KRW", "MXN", "BRL", "ZAR", "SEK", "NOK", "DKK", "PLN")
CURRENCY_SYNONYMS = {"$": "USD", "dollar": "USD", "dollars": "USD", "us": "USD", "euro": "EUR", "euros": "EUR", "pound": "GBP", "pounds": "GBP", "yen": "JPY", "yuan": "CNY", "rupee": "INR", "rupees": "INR"}

# Penalties and weights of the readiness score.
SEVERITY_PENALTY = {"critical": 0.25, "error": 0.15, "warning": 0.08, "info": 0.03}
READINESS_WEIGHTS = {"completeness": 0.25, "validity": 0.30, "consistency": 0.25, "uniqueness": 0.20}
ISSUE_OF_CORRECTION = {"normalize_date": "invalid_date", "normalize_currency": "invalid_currency", "fuzzy_match_entity": "invalid_reference", "trim_whitespace": "invalid_reference", "fill_missing": "missing_value", "remove_duplicate": "duplicate"}

# Taxonomy mapping.
STOP_WORDS = ("the", "and", "for", "with", "from", "service", "services", "system", "data")
USEFUL_NAME = r"(description|product|service|application|app|vendor|supplier|manufacturer|account|resource|asset|device|platform|technology|category|type|project)"
LAYER_ROLES = {
    "resource_tower": ("description", "vendor", "application", "service", "cloud_resource", "cloud_provider", "infrastructure_asset", "project"),
    "cost_pool": ("description", "vendor", "service", "cloud_provider"),
    "solution": ("description", "application", "service", "project", "business_unit", "department"),
}
RESOURCE_RULES = (
    (r"\b(server|virtual machine|vm|ec2|compute|mainframe)\b", r"compute", "compute technology"),
    (r"\b(storage|san|nas|disk|backup|archive)\b", r"storage", "storage technology"),
    (r"\b(router|switch|lan|wan|wifi|wireless|network|telecom)\b", r"network", "network technology"),
    (r"\b(laptop|desktop|workstation|printer|mobile device|end user)\b", r"end.?user", "end-user technology"),
    (r"\b(firewall|cyber|security|identity|iam|antivirus|vulnerability)\b", r"security|risk", "security technology"),
    (r"\b(database|middleware|container|kubernetes|runtime|blockchain|ai model)\b", r"application|platform|data", "application/platform technology"),
    (r"\b(data center|datacenter|cooling|colocation|facility)\b", r"data center", "data-center facility"),
    (r"\b(service desk|help desk|itsm|monitoring|operations support)\b", r"delivery|management", "technology delivery activity"),
)
