"""Fixed values of the policy, risk, threat and compliance rules."""

from __future__ import annotations

# How restrictive an action is; unknown actions count as 4.
STRICTNESS = {
    "BLOCK": 7,
    "REDACT": 6,
    "ENCRYPT": 5,
    "TOKENIZE": 4,
    "PSEUDONYMIZE": 3,
    "GENERALIZE": 2,
    "MASK": 2,
    "PASS": 1,
}
UNKNOWN_STRICTNESS = 4

# Data classification levels.
CLASSIFICATION_LEVELS = {"CONFIDENTIAL": 4, "RESTRICTED": 3, "INTERNAL": 2, "PUBLIC": 1}

# Per entity type the default action and the data class.
DEFAULT_ACTIONS = {
    "SSN": "REDACT",
    "CREDIT_CARD": "REDACT",
    "EMAIL": "TOKENIZE",
    "PHONE": "TOKENIZE",
    "PERSON_NAME": "TOKENIZE",
    "IP_ADDRESS": "MASK",
    "IBAN": "REDACT",
    "API_KEY": "REDACT",
    "PASSPORT": "REDACT",
    "DRIVERS_LICENSE": "REDACT",
    "DATE": "PASS",
}
DEFAULT_CLASSES = {
    "SSN": "CONFIDENTIAL",
    "CREDIT_CARD": "CONFIDENTIAL",
    "EMAIL": "RESTRICTED",
    "PHONE": "RESTRICTED",
    "PERSON_NAME": "RESTRICTED",
    "IP_ADDRESS": "INTERNAL",
    "IBAN": "RESTRICTED",
    "API_KEY": "CONFIDENTIAL",
    "PASSPORT": "CONFIDENTIAL",
    "DRIVERS_LICENSE": "CONFIDENTIAL",
    "DATE": "PUBLIC",
}

# The action that each compliance pack asks for.
COMPLIANCE_PACKS = {
    "GDPR": {
        "SSN": "REDACT",
        "CREDIT_CARD": "REDACT",
        "EMAIL": "PSEUDONYMIZE",
        "PHONE": "PSEUDONYMIZE",
        "PERSON_NAME": "PSEUDONYMIZE",
        "IP_ADDRESS": "MASK",
        "IBAN": "REDACT",
        "API_KEY": "REDACT",
        "PASSPORT": "REDACT",
        "DRIVERS_LICENSE": "REDACT",
        "DATE": "GENERALIZE",
    },
    "HIPAA": {
        "SSN": "REDACT",
        "CREDIT_CARD": "REDACT",
        "EMAIL": "REDACT",
        "PHONE": "REDACT",
        "PERSON_NAME": "REDACT",
        "IP_ADDRESS": "REDACT",
        "IBAN": "REDACT",
        "API_KEY": "REDACT",
        "PASSPORT": "REDACT",
        "DRIVERS_LICENSE": "REDACT",
        "DATE": "GENERALIZE",
    },
    "PCI_DSS": {
        "SSN": "TOKENIZE",
        "CREDIT_CARD": "REDACT",
        "EMAIL": "TOKENIZE",
        "PHONE": "TOKENIZE",
        "PERSON_NAME": "TOKENIZE",
        "IP_ADDRESS": "MASK",
        "IBAN": "REDACT",
        "API_KEY": "REDACT",
        "PASSPORT": "REDACT",
        "DRIVERS_LICENSE": "REDACT",
        "DATE": "PASS",
    },
    "CCPA": {
        "SSN": "REDACT",
        "CREDIT_CARD": "REDACT",
        "EMAIL": "TOKENIZE",
        "PHONE": "TOKENIZE",
        "PERSON_NAME": "PSEUDONYMIZE",
        "IP_ADDRESS": "MASK",
        "IBAN": "REDACT",
        "API_KEY": "REDACT",
        "PASSPORT": "REDACT",
        "DRIVERS_LICENSE": "REDACT",
        "DATE": "PASS",
    },
    "SOX": {
        "SSN": "REDACT",
        "CREDIT_CARD": "REDACT",
        "EMAIL": "TOKENIZE",
        "PHONE": "TOKENIZE",
        "PERSON_NAME": "TOKENIZE",
        "IP_ADDRESS": "TOKENIZE",
        "IBAN": "REDACT",
        "API_KEY": "REDACT",
        "PASSPORT": "REDACT",
        "DRIVERS_LICENSE": "REDACT",
        "DATE": "PASS",
    },
    "EU_AI_ACT": {
        "SSN": "REDACT",
        "CREDIT_CARD": "REDACT",
        "EMAIL": "PSEUDONYMIZE",
        "PHONE": "PSEUDONYMIZE",
        "PERSON_NAME": "PSEUDONYMIZE",
        "IP_ADDRESS": "PSEUDONYMIZE",
        "IBAN": "REDACT",
        "API_KEY": "REDACT",
        "PASSPORT": "REDACT",
        "DRIVERS_LICENSE": "REDACT",
        "DATE": "GENERALIZE",
    },
}

# Risk points per entity type, for any other type, and the levels.
RISK_WEIGHTS = {
    "SSN": 25,
    "CREDIT_CARD": 25,
    "IBAN": 20,
    "API_KEY": 30,
    "EMAIL": 8,
    "PHONE": 8,
    "PERSON_NAME": 6,
    "IP_ADDRESS": 5,
    "PASSPORT": 20,
    "DRIVERS_LICENSE": 18,
    "DATE": 3,
}
OTHER_RISK_WEIGHT = 5
BLOCK_RISK, POLICY_ESCALATION, MAX_RISK = 60, 15, 100

# Dashboard category per entity type; others are CUSTOM.
CATEGORIES = {
    "SSN": "PII",
    "EMAIL": "PII",
    "PHONE": "PII",
    "PERSON_NAME": "PII",
    "IP_ADDRESS": "PII",
    "PASSPORT": "PII",
    "DRIVERS_LICENSE": "PII",
    "DATE": "PHI",
    "CREDIT_CARD": "PCI",
    "IBAN": "FINANCIAL",
    "API_KEY": "IP_CODE",
}
CATEGORY_NAMES = ("PII", "PHI", "PCI", "FINANCIAL", "IP_CODE", "CUSTOM")

# Order of severities and their weights; unknown severities weigh 1.
SEVERITY_WEIGHTS = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}

# Frameworks (code, category, controls in total, controls passing).
FRAMEWORKS = (
    ("GDPR", "Privacy", 99, 91),
    ("HIPAA", "Healthcare", 75, 68),
    ("PCI-DSS-4", "Financial", 64, 55),
    ("CCPA", "Privacy", 45, 41),
    ("SOX", "Financial", 38, 30),
    ("EU-AI-ACT", "AI Governance", 52, 34),
    ("ISO-27701", "Privacy", 88, 82),
    ("FERPA", "Education", 28, 22),
)

# Entity types that a framework needs to see covered.
REQUIRED_TYPES = {
    "GDPR": ("PERSON_NAME", "EMAIL", "PHONE", "IP_ADDRESS", "SSN"),
    "HIPAA": ("PERSON_NAME", "SSN", "DATE", "PHONE", "EMAIL"),
    "PCI-DSS-4": ("CREDIT_CARD", "IBAN", "API_KEY"),
    "CCPA": ("PERSON_NAME", "EMAIL", "PHONE", "SSN", "IP_ADDRESS"),
    "SOX": ("PERSON_NAME", "EMAIL"),
    "EU-AI-ACT": ("PERSON_NAME", "EMAIL"),
    "ISO-27701": ("PERSON_NAME", "EMAIL", "PHONE", "SSN"),
    "FERPA": ("PERSON_NAME", "EMAIL", "DATE", "SSN"),
}

# Controls (framework, control, name, status, evidence, severity).
CONTROLS = (
    ("GDPR", "GDPR-5.1", "Data Minimization", "PASS", "ENTITY_DETECTION", "HIGH"),
    ("GDPR", "GDPR-25.1", "Privacy by Design", "PASS", "POLICY_CONFIG", "HIGH"),
    ("GDPR", "GDPR-32.1", "Pseudonymization", "PASS", "VAULT_OPERATION", "CRITICAL"),
    ("GDPR", "GDPR-26.1", "Anonymization", "PASS", "VAULT_OPERATION", "HIGH"),
    ("GDPR", "GDPR-17.1", "Right to Erasure", "FAIL", "ERASURE_CAPABILITY", "CRITICAL"),
    ("GDPR", "GDPR-15.1", "Transparency", "PASS", "AUDIT_TRAIL", "HIGH"),
    ("GDPR", "GDPR-33.1", "Breach Notification", "PASS", "AUDIT_TRAIL", "CRITICAL"),
    ("GDPR", "GDPR-6.1", "Lawful Basis", "PASS", "POLICY_CONFIG", "HIGH"),
    ("GDPR", "GDPR-35.1", "Impact Assessment", "FAIL", "POLICY_CONFIG", "MEDIUM"),
    ("GDPR", "GDPR-44.1", "Cross-Border Transfer", "PASS", "POLICY_CONFIG", "HIGH"),
    ("HIPAA", "HIPAA-SH.1", "Safe Harbor 18 Identifiers", "PASS", "ENTITY_DETECTION", "CRITICAL"),
    ("HIPAA", "HIPAA-ED.1", "Expert Determination", "FAIL", "ENTITY_DETECTION", "HIGH"),
    ("HIPAA", "HIPAA-MN.1", "Minimum Necessary Standard", "PASS", "POLICY_CONFIG", "HIGH"),
    ("HIPAA", "HIPAA-BA.1", "Business Associate Agreements", "PASS", "POLICY_CONFIG", "HIGH"),
    ("HIPAA", "HIPAA-AC.1", "Audit Controls", "PASS", "AUDIT_TRAIL", "CRITICAL"),
    ("HIPAA", "HIPAA-AE.1", "Access Enforcement", "PASS", "POLICY_CONFIG", "CRITICAL"),
    ("HIPAA", "HIPAA-TI.1", "Transmission Integrity", "PASS", "VAULT_OPERATION", "HIGH"),
    ("HIPAA", "HIPAA-EP.1", "Emergency Access", "FAIL", "POLICY_CONFIG", "MEDIUM"),
    ("HIPAA", "HIPAA-DI.1", "Data Integrity", "PASS", "AUDIT_TRAIL", "HIGH"),
    ("HIPAA", "HIPAA-DP.1", "Disposal Procedures", "PASS", "ERASURE_CAPABILITY", "HIGH"),
    ("PCI-DSS-4", "PCI-3.1", "Protect Stored Data", "PASS", "VAULT_OPERATION", "CRITICAL"),
    ("PCI-DSS-4", "PCI-6.1", "Secure Systems", "PASS", "POLICY_CONFIG", "HIGH"),
    ("PCI-DSS-4", "PCI-7.1", "Restrict Access", "PASS", "POLICY_CONFIG", "CRITICAL"),
    ("PCI-DSS-4", "PCI-8.1", "Identify Users", "FAIL", "AUDIT_TRAIL", "CRITICAL"),
    ("PCI-DSS-4", "PCI-10.1", "Track Access", "PASS", "AUDIT_TRAIL", "CRITICAL"),
    ("PCI-DSS-4", "PCI-12.1", "Security Policy", "FAIL", "POLICY_CONFIG", "HIGH"),
    ("PCI-DSS-4", "PCI-3.4", "Render PAN Unreadable", "PASS", "VAULT_OPERATION", "CRITICAL"),
    ("PCI-DSS-4", "PCI-4.1", "Encrypt Transmission", "PASS", "VAULT_OPERATION", "HIGH"),
    ("PCI-DSS-4", "PCI-9.1", "Physical Access", "PASS", "POLICY_CONFIG", "MEDIUM"),
    ("PCI-DSS-4", "PCI-11.1", "Security Testing", "FAIL", "AUDIT_TRAIL", "HIGH"),
    ("CCPA", "CCPA-RTK.1", "Right to Know", "PASS", "AUDIT_TRAIL", "HIGH"),
    ("CCPA", "CCPA-RTD.1", "Right to Delete", "PASS", "ERASURE_CAPABILITY", "CRITICAL"),
    ("CCPA", "CCPA-OPT.1", "Right to Opt-Out", "FAIL", "POLICY_CONFIG", "CRITICAL"),
    ("CCPA", "CCPA-DM.1", "Data Minimization", "PASS", "ENTITY_DETECTION", "HIGH"),
    ("CCPA", "CCPA-SP.1", "Service Provider Requirements", "PASS", "POLICY_CONFIG", "HIGH"),
    ("CCPA", "CCPA-ND.1", "Non-Discrimination", "PASS", "POLICY_CONFIG", "MEDIUM"),
    ("CCPA", "CCPA-FN.1", "Financial Incentives", "PASS", "AUDIT_TRAIL", "LOW"),
    ("CCPA", "CCPA-NM.1", "Notice at Collection", "FAIL", "POLICY_CONFIG", "HIGH"),
    ("SOX", "SOX-302.1", "CEO/CFO Certification", "PASS", "AUDIT_TRAIL", "CRITICAL"),
    ("SOX", "SOX-404.1", "Internal Controls", "PASS", "POLICY_CONFIG", "CRITICAL"),
    ("SOX", "SOX-802.1", "Record Retention (7yr)", "FAIL", "AUDIT_TRAIL", "CRITICAL"),
    ("SOX", "SOX-AT.1", "Audit Trail Integrity", "PASS", "AUDIT_TRAIL", "CRITICAL"),
    ("SOX", "SOX-AC.1", "Access Controls", "PASS", "POLICY_CONFIG", "HIGH"),
    ("SOX", "SOX-CM.1", "Change Management", "FAIL", "AUDIT_TRAIL", "HIGH"),
    ("SOX", "SOX-SE.1", "Segregation of Duties", "PASS", "POLICY_CONFIG", "HIGH"),
    ("SOX", "SOX-RM.1", "Risk Management", "PASS", "AUDIT_TRAIL", "MEDIUM"),
    ("EU-AI-ACT", "EUAI-10.1", "Data Quality", "PASS", "ENTITY_DETECTION", "CRITICAL"),
    ("EU-AI-ACT", "EUAI-13.1", "Transparency", "PASS", "AUDIT_TRAIL", "HIGH"),
    ("EU-AI-ACT", "EUAI-15.1", "Accuracy", "FAIL", "ENTITY_DETECTION", "HIGH"),
    ("EU-AI-ACT", "EUAI-52.1", "Disclosure", "FAIL", "POLICY_CONFIG", "MEDIUM"),
    ("EU-AI-ACT", "EUAI-RC.1", "Risk Classification", "PASS", "POLICY_CONFIG", "CRITICAL"),
    ("EU-AI-ACT", "EUAI-9.1", "Risk Management System", "FAIL", "AUDIT_TRAIL", "HIGH"),
    ("EU-AI-ACT", "EUAI-12.1", "Record Keeping", "PASS", "AUDIT_TRAIL", "HIGH"),
    ("EU-AI-ACT", "EUAI-14.1", "Human Oversight", "FAIL", "POLICY_CONFIG", "CRITICAL"),
    ("ISO-27701", "ISO-PIM.1", "Privacy Information Mgmt", "PASS", "POLICY_CONFIG", "HIGH"),
    ("ISO-27701", "ISO-DPR.1", "Data Processing Records", "PASS", "AUDIT_TRAIL", "HIGH"),
    ("ISO-27701", "ISO-PL.1", "Purpose Limitation", "PASS", "POLICY_CONFIG", "CRITICAL"),
    ("ISO-27701", "ISO-CM.1", "Consent Management", "FAIL", "POLICY_CONFIG", "CRITICAL"),
    ("ISO-27701", "ISO-BR.1", "Breach Response", "PASS", "AUDIT_TRAIL", "CRITICAL"),
    ("ISO-27701", "ISO-RA.1", "Rights of Access", "PASS", "AUDIT_TRAIL", "HIGH"),
    ("ISO-27701", "ISO-TP.1", "Third-Party Processing", "PASS", "POLICY_CONFIG", "HIGH"),
    ("ISO-27701", "ISO-RT.1", "Retention Policies", "FAIL", "POLICY_CONFIG", "HIGH"),
    ("FERPA", "FERPA-SR.1", "Student Records Protection", "PASS", "ENTITY_DETECTION", "CRITICAL"),
    ("FERPA", "FERPA-DI.1", "Directory Information", "FAIL", "POLICY_CONFIG", "HIGH"),
    ("FERPA", "FERPA-LEI.1", "Legitimate Educational Interest", "PASS", "POLICY_CONFIG", "HIGH"),
    ("FERPA", "FERPA-AN.1", "Annual Notification", "FAIL", "POLICY_CONFIG", "MEDIUM"),
    ("FERPA", "FERPA-AR.1", "Access and Review", "FAIL", "AUDIT_TRAIL", "HIGH"),
    ("FERPA", "FERPA-AM.1", "Amendment Rights", "FAIL", "POLICY_CONFIG", "MEDIUM"),
    ("FERPA", "FERPA-CL.1", "Complaint Filing", "PASS", "AUDIT_TRAIL", "LOW"),
    ("FERPA", "FERPA-EX.1", "Exceptions Management", "FAIL", "POLICY_CONFIG", "HIGH"),
)

# Threat patterns, all ignoring case; first matches become signals.
INJECTION_PATTERNS = (
    r"ignore\s+(all\s+)?previous\s+instructions",
    r"forget\s+(your\s+)?(rules|instructions|guidelines)",
    r"disregard\s+(all\s+)?above",
    r"you\s+are\s+now\s+(an?\s+)?",
    r"act\s+as\s+(an?\s+)?admin",
    r"pretend\s+you\s+are",
    r"forward\s+.*\s+to\s+\S+@",
    r"send\s+(all\s+|the\s+)?.*\s+(to|email)",
    r"POST\s+to\s+https?://",
    r"output\s+(the\s+)?system\s+prompt",
)
BROAD_QUERY_PATTERNS = (
    r"SELECT\s+\*",
    r"\bget\s+all\b",
    r"\blist\s+everything\b",
    r"\bfetch\s+all\b",
    r"\bretrieve\s+all\b",
    r"filter\s*=\s*\*",
    r"WHERE\s+1\s*=\s*1",
)
ESCALATION_PATTERNS = (
    r"\b(DELETE|DROP|TRUNCATE|ALTER)\b",
    r"\boverride\s+(my\s+)?role\b",
    r"\bgrant\s+(full\s+)?access\b",
    r"\b/admin/",
    r"\bprivileged\s+operation\b",
)
OVERBROAD_PATTERNS = (
    r"\bGetAll\b",
    r"filter\s*=\s*\*",
    r"\bbulk[-_]?export\b",
    r"\bno\s+pagination\b",
    r"DELETE\s+.*\*",
)
WRITE_VERB = r"\b(POST|PUT|DELETE|PATCH)\b"
TITLED_NAME = r"\b(?:Mr|Mrs|Ms|Dr)\.?\s+[A-Z][a-z]+"
LOW_ROLES = ("read-only", "viewer", "analyst", "data-processor")

# Pseudonym pools; other types get a numbered label.
PSEUDONYM_POOLS = {
    "PERSON_NAME": (
        "Alex Morgan", "Jordan Lee", "Taylor Brooks", "Casey Quinn", "Robin Park",
        "Dana Wells", "Morgan Reed", "Riley Stone", "Avery Grant", "Blake Foster",
        "Harper Cole", "Skyler Dunn", "Jamie West", "Quinn Torres", "Sage Murray",
        "Drew Pearson", "Finley Hart", "Rowan Blake", "Emery Chase", "Logan Reeves",
    ),
    "EMAIL": (
        "user_alpha@example.com", "user_beta@example.net", "user_gamma@example.org",
        "user_delta@sample.com", "user_epsilon@demo.net", "user_zeta@test.org",
        "user_eta@mock.com", "user_theta@fake.net", "user_iota@dummy.org",
        "user_kappa@proxy.com",
    ),
    "PHONE": (
        "(555) 100-0001", "(555) 200-0002", "(555) 300-0003", "(555) 400-0004",
        "(555) 500-0005", "(555) 600-0006", "(555) 700-0007", "(555) 800-0008",
    ),
    "SSN": (
        "000-00-0001", "000-00-0002", "000-00-0003", "000-00-0004",
        "000-00-0005", "000-00-0006", "000-00-0007", "000-00-0008",
    ),
}
PSEUDONYM_NUMBERS = 10_000

# Words that synthetic values are put together from.
SYNTHETIC_FIRST_NAMES = ("James", "Maria", "Chen", "Aisha", "Raj", "Elena", "Yuki", "Omar")
SYNTHETIC_LAST_NAMES = ("Smith", "Garcia", "Wang", "Okafor", "Patel", "Novak", "Tanaka", "Hassan")
SYNTHETIC_DOMAINS = ("example.com", "sample.org", "demo.net")

# Types looked for, in this order, in the keys of vault mappings.
VAULT_TYPES = (
    "SSN", "EMAIL", "PHONE", "CREDIT_CARD", "IP_ADDRESS", "PERSON_NAME",
    "IBAN", "API_KEY", "DATE", "PASSPORT", "DRIVERS_LICENSE",
)

GENESIS_HASH = "0" * 64
