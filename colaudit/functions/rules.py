"""The sensitivity rules, as data."""

from __future__ import annotations

# --- fixed values: patterns, types and weights that give the audit's scores ---------------------

#: id, pattern on the normalised name, type, weight; the first listed wins ties.
NAME_RULES = [
    ("govt_id_ssn", r"\b(ssn|social security( (no|number))?|sin|nino|national insurance)\b", "government_id", 0.95),
    ("govt_id_other", r"\b(passport( no| number)?|aadhaar|aadhar|\bpan\b|tax(payer)? id|\btin\b|driver'?s? licen[cs]e|voter id|national id)\b", "government_id", 0.9),
    ("knowledge_based", r"\b(mother'?s? maiden|maiden name|security question|security answer|secret question|challenge answer)\b", "knowledge_based", 0.9),
    ("credential_password", r"\b(password|passwd|pwd|passphrase)\b", "credential", 0.88),
    ("credential_secret", r"\b(secret|api key|private key|access key|client secret|auth token|refresh token|bearer)\b", "credential", 0.82),
    ("credential_weak", r"\b(otp|totp|mfa|2fa|pin( code)?|cvv|cvc|session token)\b", "credential", 0.6),
    ("contact_email", r"\b(e ?mail( address)?)\b", "contact", 0.9),
    ("contact_phone", r"\b(phone( number)?|telephone|mobile( number)?|msisdn|cell( phone)?|fax|whatsapp( number)?)\b", "contact", 0.85),
    ("financial_account", r"\b(card number|card no|cardnum|cc num(ber)?|primary account number|\bpan\b|iban|bank account|account number|acct( no| number)|routing( number)?|sort code)\b", "financial", 0.88),
    ("financial_meta", r"\b(card( |_)?last ?4|last ?4 digits|card bin|card exp\w*|expiry date)\b", "financial", 0.5),
    ("health", r"\b(health|medical|diagnos\w+|disease|condition|medication|prescription|blood type|allerg\w+|disabilit\w+|insurance (id|member|number))\b", "health", 0.9),
    ("special_category", r"\b(race|ethnic\w*|religio\w+|sexual orientation|gender identity|political( affiliation| opinion)?|trade union|biometric|genetic|immigration status)\b", "special_category", 0.9),
    ("identity_dob", r"\b(dob|date of birth|birth ?date|birthday|born( on)?|year of birth)\b", "identity", 0.8),
    ("address", r"(?<!ip )(?<!mac )(?<!url )(?<!web )(?<!host )(?<!email )address(es)?\b|\b(street|home address|mailing address|postal address|billing address|shipping address|delivery address|address line|zip ?code|postal ?code|postcode|pin ?code|\baddr\b)\b", "address", 0.8),
    ("address_weak", r"\b(city|county|province|district|locality)\b", "address", 0.4),
    ("network_ip", r"\b(ip( address)?|ipv4|ipv6|ipaddr|last ip|client ip|remote addr|x forwarded for|source ip)\b", "network_id", 0.6),
    ("network_device", r"\b(mac address|device id|device token|udid|imei|advertising id|user agent|fingerprint)\b", "network_id", 0.55),
    ("geo", r"\b(latitude|longitude|geo location|gps|coordinates?|geohash)\b", "network_id", 0.6),
    ("identity_name_full", r"\b(full name|first name|last name|middle name|given name|sur ?name|maiden name|legal name|f ?name|l ?name)\b", "identity", 0.6),
    ("identity_name_bare", r"\b(name)\b", "identity", 0.42),
    ("identity_username", r"\b(user ?name|screen ?name|nick ?name|handle|display name)\b", "identity", 0.4),
    ("demographic", r"\b(gender|\bsex\b|marital status|nationality|citizenship|country of birth|mother tongue|pronouns?)\b", "demographic", 0.55),
    ("freetext_body", r"\b(body|message( body| text)?|content|transcript|conversation|chat log|note body)\b", "freetext", 0.5),
    ("freetext_notes", r"\b(notes?|comments?|remarks?|memo|description text|free ?text|bio|about( me)?)\b", "freetext", 0.32),
    ("freetext_subject", r"\b(subject|title|headline|summary)\b", "freetext", 0.25),
    ("contact_social", r"\b(twitter|facebook|instagram|linkedin|telegram|signal|social handle)\b", "contact", 0.55),
    ("preference_consent", r"\b(consent|opt in|opt out|newsletter|marketing( consent)?|subscribe\w*|do not (track|sell))\b", "preference", 0.2),
    ("activity", r"\b(last login|last seen|last active|login count|failed logins?)\b", "activity", 0.15),
]
#: id, pattern of the whole value, type, weight; the first match of a value counts.
VALUE_RULES = [
    ("ssn_like", r"\d{3}-\d{2}-\d{4}", "government_id", 0.92),
    ("iso_date", r"(19|20)\d\d-\d\d-\d\d", "identity", 0.35),
    ("ipv4", r"(\d{1,3}\.){3}\d{1,3}", "network_id", 0.7),
    ("ipv6", r"([0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}", "network_id", 0.7),
    ("email", r"[^@\s]+@[^@\s]+\.[^@\s]{2,}", "contact", 0.85),
    ("credit_card", r"\d{13,19}", "financial", 0.8),
    ("uuid", r"[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}", None, 0.08),
    ("phone_like", r"\+?\d[\d\s().-]{6,17}\d", "contact", 0.7),
]
#: id, pattern inside longer text, type, weight.
EMBEDDED_RULES = [
    ("email_in_text", r"[^@\s]+@[^@\s]+\.[a-z]{2,}", "contact", 0.5),
    ("ssn_in_text", r"\b\d{3}-\d{2}-\d{4}\b", "government_id", 0.55),
    ("phone_in_text", r"(?<!\d)\+?\d[\d\s().-]{8,}\d(?!\d)", "contact", 0.35),
]
#: id, pattern on the normalised name of columns that are harmless.
HARMLESS_RULES = [
    ("color", r"\b(colou?r|favou?rite colou?r)\b"),
    ("ui_pref", r"\b(theme|dark mode|light mode|font size|layout|density|ui setting)\b"),
    ("locale", r"\b(locale|language|lang|timezone|time zone|\btz\b|currency|country code|units?)\b"),
    ("boolean_flag", r"\b(is [a-z]+|has [a-z]+|enabled|disabled|active|inactive|archived|deleted|verified|flag)\b"),
    ("status_enum", r"\b(status|state|stage|phase|kind|type|category|tier|level|priority|severity|mode|reason)\b"),
    ("timestamp", r"\b(created|updated|modified|inserted|deleted|resolved|closed|expired|processed|synced|timestamp)\b"),
    ("counter_money", r"\b(count|total|subtotal|sum|amount|qty|quantity|balance|price|cost|fee|discount|rate|ratio|percent\w*|score|points?|stars?|rating|nps|csat|sentiment)\b"),
    ("identifier", r"\b(uuid|guid|slug|token id|ref|reference|\bcode\b|checksum|\bhash\b|etag|version|revision|\bseq\b|sequence|index|ordinal|position|\brank\b|sort order)\b"),
    ("system_meta", r"\b(file name|table name|column name|field name|host name|class name|event name|action name|product name|brand|make|model|sku|mime type|extension|url path|endpoint)\b"),
]
#: generic type -> type, weight.
TYPE_RULES = {"inet": ("network_id", 0.6)}
#: Formats whose share among samples is a feature.
SIGNATURES = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]{2,}$",
    "phone": r"^\+?[\d][\d\s().-]{6,17}\d$",
    "ssn_shaped": r"^\d{3}-\d{2}-\d{4}$",
    "ipv4": r"^(\d{1,3}\.){3}\d{1,3}$",
    "ipv6": r"^[0-9a-fA-F:]+:[0-9a-fA-F:]+$",
    "uuid": r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    "numeric": r"^-?\d+(\.\d+)?$",
    "iso_date": r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}.*)?$",
    "all_caps_token": r"^[A-Z0-9_]{2,}$",
    "hex_blob": r"^[0-9a-fA-F]{16,}$",
}
TYPE_FAMILIES = ["string", "text", "integer", "numeric", "float", "boolean", "date", "timestamp", "timestamptz", "time", "interval", "uuid", "inet", "json", "bytes", "array", "other"]
# --- end of fixed values ----------------------------------------------------------------------
