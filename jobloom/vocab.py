"""Vocabularies, month names and phrases that results depend on.

Dictionary order is part of the meaning: ties between equally long keywords go
to the category that is listed first.
"""

from __future__ import annotations

# --- fixed values: districts, in the order they are tried -------------------
DISTRICTS = [
    "kigali", "gasabo", "kicukiro", "nyarugenge", "musanze", "rubavu", "rusizi", "huye",
    "rwamagana", "muhanga", "karongi", "nyamasheke", "nyagatare", "gatsibo", "kayonza", "kirehe",
    "ngoma", "bugesera", "nyanza", "gisagara", "nyaruguru", "ruhango", "kamonyi", "gakenke",
    "rulindo", "gicumbi", "burera", "ngororero", "nyabihu", "rutsiro", "rubirizi",
]
DISTRICTS_SHORT = [d for d in DISTRICTS if d != "rubirizi"]
DISTRICTS_CITY_AREAS = DISTRICTS_SHORT + ["kibagabaga", "remera", "kimironko", "gikondo"]
# used with "unknown text is the district" parsing, keeps its own spelling and order
DISTRICTS_TOWNS = [
    "Kigali", "Butaro", "Byumba", "Cyangugu", "Gisenyi", "Gitarama", "Kayonza", "Kibuye",
    "Nyanza", "Rubengera", "Ruhengeri", "Rusumo", "Rwamagana", "Musanze", "Huye", "Ngoma",
    "Nyarugenge", "Gasabo", "Kicukiro", "Bugesera", "Gatsibo", "Karongi", "Nyabihu",
    "Nyagatare", "Nyamagabe", "Nyamasheke", "Nyaruguru", "Rubavu", "Ruhango", "Rulindo",
    "Rusizi", "Rutsiro", "Gisagara", "Kirehe", "Muhanga", "Ngororero", "Gicumbi",
]

# --- fixed values: sector keywords ------------------------------------------
SECTOR = {
    "Health": [
        "nurse", "doctor", "physician", "surgeon", "pharmacist", "midwife", "clinical",
        "epidemiolog", "laboratory", "radiology", "dentist", "public health", "hospital",
        "nutrition", "dietitian", "health worker", "community health", "hiv", "malaria",
        "tuberculosis",
    ],
    "Finance": [
        "accountant", "accounting", "auditor", "audit", "tax consultant", "financial analyst",
        "chief financial", "cfo", "treasurer", "budget analyst", "microfinance",
        "investment analyst", "credit analyst", "actuary", "bookkeeper",
    ],
    "Agriculture": [
        "agronomist", "agronomy", "horticulture", "livestock", "veterinary", "crop", "soil",
        "irrigation", "aquaculture", "agri-business", "agricultural extension",
        "rural development", "food security",
    ],
    "Education": [
        "teacher", "lecturer", "professor", "headmaster", "principal", "curriculum developer",
        "academic", "school", "university", "early childhood", "pedagog", "education officer",
    ],
    "Construction": [
        "architect", "structural engineer", "quantity surveyor", "site engineer",
        "construction manager", "civil engineer", "urban planner", "land surveyor",
        "building inspector",
    ],
    "Logistics": [
        "supply chain", "logistics officer", "warehouse", "procurement officer",
        "fleet manager", "customs officer", "freight", "import/export", "inventory manager",
        "distribution",
    ],
    "HR": [
        "human resource", "hr officer", "hr manager", "recruiter", "talent acquisition",
        "payroll officer", "people operations", "organizational development",
        "hr business partner",
    ],
    "Marketing": [
        "marketing officer", "brand manager", "communications officer", "digital marketer",
        "social media manager", "content creator", "public relations", "copywriter",
        "media officer", "advertising",
    ],
    "NGO": [
        "ngo", "ingo", "unicef", "undp", "usaid", "world bank", "oxfam", "save the children",
        "care international", "irc", "mercy corps", "msf", "humanitarian", "donor relations",
        "grant", "m&e officer", "monitoring and evaluation",
    ],
    "IT": [
        "software engineer", "software developer", "web developer", "mobile developer",
        "frontend developer", "backend developer", "fullstack developer", "data engineer",
        "data scientist", "machine learning", "devops engineer", "cloud engineer",
        "network engineer", "cybersecurity", "database administrator",
        "systems administrator", "it support", "it officer", "it manager", "ict officer",
        "programmer", "ui/ux designer",
    ],
}
# words the two boards with a Tender category leave out of the base lists
_NOT_ON_TENDER_BOARDS = {
    "tuberculosis", "pedagog", "building inspector", "import/export",
    "organizational development", "media officer", "advertising", "donor relations", "grant",
    "m&e officer",
}
TENDER_DAILY = [
    "tender", "supply of", "provision of", "request for proposal", "expression of interest",
    "eoi", "rfp", "rfq", "bid", "addendum", "consultancy services", "framework contract",
]
TENDER_PORTAL = [
    "tender", "supply of", "provision of", "request for proposal", "expression of interest",
    "eoi", "rfp", "rfq", "bid", "framework contract", "notice for supply",
    "notice for provision", "terms of reference", "tor", "consultancy services",
]


def sector_with_tender(tender: list[str]) -> dict[str, list[str]]:
    """The trimmed base lists with ``Tender`` placed before ``IT``."""
    out: dict[str, list[str]] = {}
    for name, words in SECTOR.items():
        if name == "IT":
            out["Tender"] = tender
        out[name] = [w for w in words if w not in _NOT_ON_TENDER_BOARDS]
    return out


# --- fixed values: level, employment type, education, currency --------------
LEVEL = {
    "Internship": ["intern", "attachment", "apprentice"],
    "Entry": ["entry", "junior", "fresh", "graduate", "trainee", "0-1 year", "1 year"],
    "Mid": ["mid", "2-3 year", "3-5 year", "2 years", "3 years", "4 years", "5 years"],
    "Senior": [
        "senior", "lead", "principal", "expert", "6+ year", "7+ year", "8+ year", "10+ year",
        "manager", "head of", "director",
    ],
    "Executive": [
        "ceo", "cfo", "cto", "coo", "vp ", "vice president", "executive director",
        "country director", "chief",
    ],
}
EMPLOYMENT = {
    "Full-time": ["full-time", "full time", "permanent", "indefinite"],
    "Part-time": ["part-time", "part time"],
    "Contract": ["contract", "fixed-term", "fixed term", "temporary"],
    "Internship": ["intern", "attachment", "apprentice"],
    "Consultancy": ["consultant", "consultancy", "freelance"],
    "Volunteer": ["volunteer", "voluntary"],
}
EDUCATION = {
    "PhD": ["phd", "doctorate", "doctoral"],
    "Master's": ["master", "msc", "mba", "ma ", "m.sc", "m.a."],
    "Bachelor's": [
        "bachelor", "bsc", "ba ", "b.sc", "b.a.", "degree", "undergraduate", "university",
    ],
    "Diploma": ["diploma", "a-level", "advanced level", "hnd"],
    "Certificate": ["certificate", "o-level", "tvet", "vocational"],
}
CURRENCY = {
    "RWF": ["rwf", "frw", "francs rwandais"],
    "USD": ["usd", "$", "dollars"],
    "EUR": ["eur", "euros"],
}


def _plus(base: dict[str, list[str]], **extra: list[str]) -> dict[str, list[str]]:
    names = {n.replace("-", "_").replace("'", ""): n for n in base}
    more = {names[k]: v for k, v in extra.items()}
    return {n: words + more.get(n, []) for n, words in base.items()}


EMPLOYMENT_TOR = _plus(EMPLOYMENT, Consultancy=["terms of reference", "tor"])
EMPLOYMENT_UN = _plus(
    EMPLOYMENT, Contract=["fixed term position"], Internship=["internship"],
    Consultancy=["individual contractor"], Volunteer=["unv", "un volunteer"],
)
EMPLOYMENT_POOL = _plus(
    EMPLOYMENT, Contract=["agreement"], Consultancy=["individual contractor"],
    Volunteer=["unv", "un volunteer"],
)
EMPLOYMENT_NO_SHORT_INTERN = {**EMPLOYMENT, "Internship": ["internship", "attachment", "apprentice"]}
EDUCATION_LOCAL = _plus(EDUCATION, Bachelors=["a0"], Diploma=["a1", "a2"])
EDUCATION_A2_MASTER = _plus(EDUCATION, Masters=["a2"], Bachelors=["a0"], Diploma=["a1"])
EDUCATION_UN = _plus(EDUCATION, Masters=["advanced university"])

# keywords that need word boundaries however long they are
BOUNDARY_WORDS = {
    "ceo", "cfo", "cto", "coo", "vp", "intern", "ngo", "ingo", "msf", "irc", "hiv", "ba ", "ma ",
}

# --- fixed values: first-match sector map of the web board ------------------
SECTOR_FIRST_MATCH = {
    "it": "IT", "telecom": "IT", "technology": "IT", "computer": "IT", "software": "IT",
    "developer": "IT", "programmer": "IT", "engineering": "Engineering",
    "health": "Healthcare", "medicine": "Healthcare", "medical": "Healthcare",
    "healthcare": "Healthcare", "nursing": "Healthcare", "clinical": "Healthcare",
    "education": "Education", "teaching": "Education", "academic": "Education",
    "teacher": "Education", "finance": "Finance", "accounting": "Finance",
    "banking": "Finance", "accountant": "Finance", "hr": "HR", "human resource": "HR",
    "marketing": "Marketing", "sales": "Sales", "agriculture": "Agriculture",
    "agricultural": "Agriculture", "farming": "Agriculture", "construction": "Construction",
    "real estate": "Construction", "legal": "Legal", "law": "Legal",
    "procurement": "Procurement", "purchasing": "Procurement", "ngo": "NGO",
    "development": "Development", "logistics": "Logistics", "transport": "Logistics",
    "warehouse": "Logistics", "hospitality": "Hospitality", "hotel": "Hospitality",
    "tourism": "Hospitality", "customer service": "Customer Service",
    "client service": "Customer Service", "administrative": "Administration",
    "secretarial": "Administration", "office": "Administration",
    "manufacturing": "Manufacturing", "production": "Manufacturing", "retail": "Retail",
    "consulting": "Consulting", "security": "Security",
}
TITLE_SENIOR_WORDS = [
    "senior", "lead", "principal", "head", "director", "chief", "manager", "supervisor",
    "executive", "coordinator",
]
TITLE_JUNIOR_WORDS = [
    "junior", "assistant", "associate", "entry", "graduate", "intern", "trainee", "fresh",
]
CATEGORY_EMPLOYMENT = {
    "job": "Full-time", "consultancy": "Consultancy", "internship": "Internship",
    "volunteer": "Volunteer", "training": "Training", "other": "Contract",
}

# --- fixed values: eligibility phrases --------------------------------------
DISQUALIFIERS_FULL = [
    "us citizens only", "eu residents only", "must be based in", "authorized to work in the us",
    "work permit required (not rwanda)",
]
DISQUALIFIERS_BASED = DISQUALIFIERS_FULL[:4]
DISQUALIFIERS_SHORT = ["us citizens only", "eu residents only", "authorized to work in the us"]
COUNTRY_SIGNALS = ["rwanda", "kigali"]

# --- fixed values: dates ----------------------------------------------------
MONTH_ABBR = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_NAMES = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september",
    "october", "november", "december",
]
NOT_A_DATE = [
    "ongoing", "continuous", "rolling", "asap", "immediate", "open", "n/a", "tbd",
    "to be determined",
]

# --- fixed values: multi-position announcements -----------------------------
TITLE_JOB_WORDS = [
    "manager", "officer", "specialist", "coordinator", "assistant", "director", "head", "chief",
    "senior", "junior", "accountant", "engineer", "developer", "analyst", "consultant",
    "technician", "supervisor", "administrator", "clerk", "secretary", "receptionist", "teacher",
    "lecturer", "professor", "nurse", "doctor", "driver", "designer", "architect", "lawyer",
    "auditor", "planner", "adviser", "advisor", "expert", "intern", "trainee", "collector",
    "agent", "representative", "cashier", "teller", "guard", "security",
]
TITLE_SKIP_WORDS = [
    "deadline", "apply", "click here", "contact", "email", "requirements", "qualifications",
    "how to apply",
]
LIST_INDICATORS = [
    "following positions", "following vacancies", "positions are", "vacancies are",
    "hiring for", "looking for", "positions:", "jobs:",
]
