"""Fixed values that normalisation, blocking and policies share."""

# Legal forms.
LEGAL_FORMS = [
    "LLC", "INC", "INCORPORATED", "CORP", "CORPORATION", "LTD", "LIMITED",
    "CO", "COMPANY", "LLP", "PLC", "HOLDINGS", "GROUP", "ENTERPRISES", "INDUSTRIES",
    "PVT", "PRIVATE", "PVT LTD", "PRIVATE LIMITED", "LTD CO",
    "SARL", "SAS", "SA", "EURL", "SNC", "SCI", "SCOP", "GIE", "GMBH",
]

# The shorter lists that single plans strip or count, by plan.
SHORT_LEGAL_FORMS = ["pvt", "ltd", "limited", "private", "llc", "inc", "corp", "corporation", "co", "company", "sarl", "sas", "sa", "eurl", "llp"]
INDEX_LEGAL_FORMS = ["llc", "inc", "corp", "corporation", "ltd", "limited", "pvt", "private", "co", "company", "llp", "plc", "sarl", "sas", "sa", "eurl", "snc"]
NOTEBOOK_LEGAL_FORMS = [
    "llc", "inc", "corp", "corporation", "ltd", "limited", "pvt", "private", "co", "company", "llp", "plc",
    "sarl", "sas", "sa", "eurl", "snc", "sci", "gie", "gmbh", "ag", "spa", "srl", "sl",
]
AUDIT_LEGAL_FORMS = ["LLC", "INC", "CORP", "CORPORATION", "LTD", "LIMITED", "PVT", "PRIVATE", "CO", "COMPANY", "LLP", "GMBH", "SA", "SAS", "SARL", "PLC", "EURL", "SNC"]
PROFILE_LEGAL_FORMS = ["LLC", "INC", "CORP", "CORPORATION", "LTD", "LIMITED", "PVT", "PRIVATE", "CO", "COMPANY", "LLP", "GMBH", "SA", "SAS", "SARL", "PLC"]

# Abbreviation to its long form.
ABBREVIATIONS = {
    "CORP": "CORPORATION", "INC": "INCORPORATED", "PVT": "PRIVATE", "LTD": "LIMITED",
    "CO": "COMPANY", "BROS": "BROTHERS", "ASSN": "ASSOCIATION", "MFG": "MANUFACTURING",
    "DIST": "DISTRIBUTION", "INTL": "INTERNATIONAL", "NATL": "NATIONAL", "TECH": "TECHNOLOGY",
    "INFO": "INFORMATION", "SYS": "SYSTEMS", "COMM": "COMMUNICATIONS", "MED": "MEDICAL",
    "PHARM": "PHARMACEUTICAL", "DEV": "DEVELOPMENT", "MKTG": "MARKETING", "CONS": "CONSULTING",
    "ENG": "ENGINEERING", "SVCS": "SERVICES", "TRDG": "TRADING", "ENT": "ENTERPRISES",
    "IND": "INDUSTRIES", "DEPT": "DEPARTMENT",
    "ST": "STREET", "RD": "ROAD", "AVE": "AVENUE", "BLVD": "BOULEVARD",
    "DR": "DRIVE", "LN": "LANE", "HWY": "HIGHWAY", "SQ": "SQUARE", "PL": "PLACE",
    "CT": "COURT", "STE": "SUITE", "APT": "APARTMENT", "FL": "FLOOR", "CTR": "CENTER",
    "PKWY": "PARKWAY", "CIR": "CIRCLE", "WAY": "WAY", "TER": "TERRACE", "BLDG": "BUILDING",
    "RUE": "RUE", "BD": "BOULEVARD", "AV": "AVENUE", "IMP": "IMPASSE", "ALL": "ALLEE",
    "CHE": "CHEMIN", "RTE": "ROUTE", "ZA": "ZONE", "ZI": "ZONE", "ZAC": "ZONE",
    "SOC": "SOCIETE", "ETS": "ETABLISSEMENTS",
}

# Words that tell no record from another.
STOPWORDS = [
    "the", "and", "of", "in", "for", "to", "at", "by", "on", "a", "an",
    "co", "company", "services", "service", "enterprises", "enterprise",
    "group", "holdings", "holding", "solutions", "solution", "systems", "system",
    "associates", "consultants", "consulting", "management", "international", "national",
    "india", "us", "usa", "france", "corporation", "limited", "private", "llc", "inc", "pvt", "ltd",
]

# Rewrites of the consonant skeleton, in order.
DIGRAPHS = [("ee", "i"), ("oo", "u"), ("w", "v"), ("sh", "s"), ("ch", "c"), ("dh", "d"), ("th", "t"), ("bh", "b"), ("ph", "f"), ("kh", "k"), ("gh", "g"), ("jh", "j")]

# Devanagari letters to Latin.
VOWELS = {
    "अ": "a", "आ": "a", "इ": "i", "ई": "i", "उ": "u", "ऊ": "u", "ऋ": "ri", "ए": "e",
    "ऐ": "ai", "ऑ": "o", "ऒ": "o", "ओ": "o", "औ": "au",
}
MATRAS = {
    "ा": "a", "ि": "i", "ी": "i", "ु": "u", "ू": "u", "ृ": "ri", "े": "e", "ै": "ai",
    "ॉ": "o", "ॊ": "o", "ो": "o", "ौ": "au",
}
CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "ng", "च": "ch", "छ": "ch", "ज": "j",
    "झ": "jh", "ञ": "ny", "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n", "त": "t",
    "थ": "th", "द": "d", "ध": "dh", "न": "n", "प": "p", "फ": "f", "ब": "b", "भ": "bh",
    "म": "m", "य": "y", "र": "r", "ल": "l", "ळ": "l", "व": "v", "श": "sh", "ष": "sh",
    "स": "s", "ह": "h", "क़": "q", "ख़": "kh", "ग़": "g", "ज़": "z", "ड़": "r", "ढ़": "rh",
    "फ़": "f", "य़": "y",
}

# First code points of the Brahmic blocks that are laid out like Devanagari (U+0900).
BLOCKS = {"Bengali": 0x0980, "Gurmukhi": 0x0A00, "Gujarati": 0x0A80, "Odia": 0x0B00, "Tamil": 0x0B80, "Telugu": 0x0C00, "Kannada": 0x0C80, "Malayalam": 0x0D00}

# Patterns of telephone numbers and titles in domain names, of postal codes by country, of numbers joined by
# slashes, of letters with a house number, and of numbers after letters.
DOMAIN_PHONE = r"[\s\-]+[0-9]{7,12}\b"
DOMAIN_TITLE = r"^(?:m/s|ms|mrs|mr|smt|sri|shri|dr|the)\b[\s\.]*"
POSTAL_CODES = {"India": "[1-9][0-9]{5}", "US": "[0-9]{5}", "France": "[0-9]{5}"}
OTHER_POSTAL_CODE = "[0-9]{5,6}"
SLASH_NUMBERS = r"\d+(?:[/-]\d+)+"
HOUSE_LETTER = r"#?([a-z]{1,2})[\s\-]?(\d{1,5})\b"
NUMBER_AFTER = r"([a-z/#\-]+)(\d+)"

# Strings that stand for null.
NULL_TOKENS = ["", "NULL", "null", "None", "NaN", "nan"]

# Words before a name, endings of domains, words before a house number, and pairs that are no house token.
HONORIFICS = r"^(?:m/s|m\\s|ms|mrs|mr|smt|sri|shri|dr|the)\b[\s.\-/]*"
DOMAIN_WHOLE = r"^(?:https?://)?(?:www\.)?([a-z0-9\-]+)(?:\.com|\.in|\.org|\.net|\.co\.in|\.co|\.us|\.io|\.biz|\.info)(?:/.*)?$"
DOMAIN_INSIDE = r"\b([a-z0-9\-]{3,})\.(?:com|in|org|net|co\.in|co|us|biz)\b"
HOUSE_WORDS = r"\b(door|shop|flat|pno|plot|h[\.\s]?no|house[\.\s]?no|unit|room|block|blk|noa)[\s\.\-\#:]*(?:no[\s\.\-:]*)?([a-z0-9\-/]+)"
NO_HOUSE_PREFIX = ["in", "to", "at", "on", "th", "st", "nd", "rd", "fl"]

# The decision policy's grid and defaults, and the threshold sweep.
POLICY_ABSOLUTE = [0.40, 0.50, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85]
POLICY_GUARD = [0.0, 0.50, 0.65, 0.75, 0.80]
POLICY_RELATIVE = [0.0, 0.60, 0.75, 0.85]
POLICY_DEFAULT = (0.65, 0.65, 0.75)
THRESHOLDS = [0.10, 0.20, 0.30, 0.40, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95]

# Strategies of each family of blocking keys.
FAMILIES = {
    "exact": ["B01_exact_name", "B02_no_legal_suffix", "B03_sorted_tokens", "B13_name_no_space"],
    "token": ["B05_first_two_tokens", "B14_first_distinctive_token", "B18_distinctive_token_pair", "B19_first_last_distinctive", "TB01_honorific_tok0"],
    "postal": ["B08_postal_name_pfx", "B09_postal_house", "B21_postal_distinctive_tok", "B26_soundex_postal", "TB05_indic_translit_postal", "TB06_postal_sorted_numeric", "TB07_postal_slash_compound", "TB08_postal_house_token", "TB11_postal_addr_token_pair"],
    "numeric": ["B07_house_tok0", "B10_token_numeric", "B20_tok1_house", "B23_numeric_sig_name", "B27_phonetic_house", "TB12_translit_house_sig", "SB03_multiscript_translit_numeric", "SB04_lstrip_zeros_numeric_name", "SB07_pure_addr_tok0_numeric"],
    "phonetic": ["B24_phonetic_tok0", "B25_phonetic_pair", "B26_soundex_postal", "B27_phonetic_house"],
    "indic": ["TB04_indic_translit_tok0", "TB05_indic_translit_postal", "TB12_translit_house_sig", "SB01_multiscript_translit_tok0", "SB02_multiscript_translit_pair", "SB03_multiscript_translit_numeric"],
    "pure_addr": ["SB05_pure_addr_postal_distinctive", "SB06_pure_addr_distinctive_pair", "SB07_pure_addr_tok0_numeric"],
}
