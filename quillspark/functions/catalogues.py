"""Code patterns, word lists and phrases of the question-answering domain. All are parameters of the
operators; the values themselves are facts of that domain and have to stay as they are."""

CODES = {
    "uns": [(r"\b[SNCGHJKWRT]\d{5}\b", 0)],
    "astm": [(r"\b(?:ASTM\s*)?A\d{3,4}(?:[/-]\d{2,4})?\b", 0)],
    "api": [(r"\bAPI[\s-]+(?:SPEC(?:IFICATION)?\s+)?(\d{1,2}[A-Z]{1,4})\b", 1)],
    "grade": [(r"\b(?:2205|2507|2304|2101|316L?|304L?|317L?|321|347|410|420|430|446)\b", 0), (r"\b(?:J55|K55|N80|L80|C90|C95|T95|P110|Q125|C110|13CR|R95|S135|V150)\b", 0)],
    "nace": [(r"\b(?:NACE\s*)?MR\d{4}(?:/ISO\s*\d+)?\b", 0), (r"\bISO\s*15156(?:-\d+)?\b", 0)],
}
SECTION = r"\b(?:section|clause|para(?:graph)?|subsection)\s*(\d+(?:\.\d+)+)"
SECTION_CONTEXT = r"\b(?:scope|about|says?|describes?|covers?|regarding|refers?\s+to|meaning\s+of|details?\s+of)\b"
ENTITIES = {
    "grades": [(r"\bF\d{2,3}[A-Z]?\b", 0)],
    "uns": [(r"\b(?:S|J)\d{5}\b", 0)],
    "standards": [(r"\bA\d{3,4}(?:/A\d{3,4}M)?\b", 0)],
}
PROPERTY_WORDS = [
    "yield", "tensile", "elongation", "hardness", "hrc", "hbw", "hvn", "pren", "charpy", "impact", "ksi", "mpa", "ferrite", "austenite", "annealing",
    "solution", "quench", "temper", "nitrogen", "chromium", "molybdenum", "nickel", "carbon", "manganese", "phosphorus", "phosphorous", "sulfur",
    "silicon", "copper", "tungsten", "cobalt", "vanadium", "titanium", "niobium", "columbium", "aluminum", "boron", "cr", "mo", "ni", "mn", "si",
    "cu", "co", "ti", "nb", "al", "temperature", "quenching", "cooling", "chemical", "composition", "requirements", "minimum", "maximum", "thickness",
    "tolerance", "permissible", "strengths", "temperatures", "tolerances", "properties", "min", "max", "psi", "flattening", "hydrostatic",
    "transverse", "longitudinal", "casing", "tubing", "coupling", "connection", "collapse", "burst", "scope", "marking", "supplementary",
    "inspection", "certification", "certificate", "dimensional", "dimensions",
]
SYNONYMS = {
    "yield": ["yield strength", "Ys", "0.2% proof", "offset yield"],
    "tensile": ["tensile strength", "UTS", "ultimate tensile", "Rm"],
    "hardness": ["HBW", "HRC", "Brinell", "Rockwell", "HV", "Vickers"],
    "elongation": ["elongation at break", "El", "%El", "A%"],
    "impact": ["Charpy", "impact test", "CVN", "notch toughness"],
    "annealing": ["solution anneal", "solution treatment", "heat treatment"],
    "quench": ["quenching", "water quench", "rapid cooling"],
    "scope": ["coverage", "applicability", "specification covers"],
    "requirements": ["shall", "must", "mandatory", "required"],
}
ELEMENTS = {
    "nitrogen": "N", "chromium": "Cr", "molybdenum": "Mo", "nickel": "Ni", "carbon": "C", "manganese": "Mn", "phosphorus": "P", "phosphorous": "P", "sulfur": "S", "silicon": "Si",
    "copper": "Cu", "tungsten": "W", "cobalt": "Co", "vanadium": "V", "titanium": "Ti", "niobium": "Nb", "columbium": "Nb", "aluminum": "Al", "boron": "B", "iron": "Fe",
}
GRADE_TO_UNS = {
    "f50": "S31200", "f51": "S31803", "f52": "S32950", "f53": "S32750", "f54": "S39274", "f55": "S32760", "f57": "S39277", "f59": "S32520", "f60": "S32205", "f61": "S32550",
    "2205": "S32205", "2507": "S32750", "2304": "S32304", "255": "S32550", "329": "S32900",
}
ABBREVIATIONS = {
    "ys": "yield strength", "ts": "tensile strength", "el": "elongation", "cr": "chromium", "ni": "nickel", "mo": "molybdenum", "n": "nitrogen", "c": "carbon", "mn": "manganese",
    "p": "phosphorus", "s": "sulfur", "si": "silicon", "cu": "copper", "w": "tungsten", "co": "cobalt",
}
STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "must", "shall", "can", "need", "what", "which", "who", "when", "where", "why", "how", "this", "that", "these", "those",
    "it", "its", "of", "for", "to", "in", "on", "at", "by", "with", "from", "and", "or", "but", "not", "if", "as", "so", "than", "then", "about",
    "into", "through", "during", "before", "after", "above", "below", "between", "under", "again", "further", "once", "here", "there", "all", "any",
    "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "only", "own", "same", "too", "very", "just", "also",
]
INJECTIONS = [
    r"\[SYSTEM\]", r"\[INST\]", r"\[/INST\]", r"<\|im_start\|>", r"<\|im_end\|>", r"<\|system\|>", r"<\|user\|>", r"<\|assistant\|>", r"</s>", r"<<SYS>>", r"</SYS>>",
    r"ignore\s+(?:previous|above|all)\s+(?:instructions?|rules?|prompts?)", r"disregard\s+(?:previous|above|all)\s+(?:instructions?|rules?|prompts?)",
    r"forget\s+(?:previous|above|all)\s+(?:instructions?|rules?|prompts?)", r"new\s+instructions?:", r"override\s+(?:system|instructions?|rules?)",
    r"you\s+are\s+now\s+(?:a|an|the)", r"pretend\s+(?:to\s+be|you\s+are)", r"act\s+as\s+(?:a|an|if)", r"roleplay\s+as",
    r"jailbreak", r"DAN\s+mode", r"developer\s+mode", r"bypass\s+(?:filter|safety|restriction)",
]
CLAIMS = [r"(?:maximum|minimum|min|max|shall|must|required).*?(?:\d+|\w+ \d+)", r"UNS [A-Z]\d{5}", r"ASTM [A-Z]\d+", r"\d+(?:\.\d+)?%?\s*(?:HRC|HBW|ksi|MPa|°F|°C)"]
#: Codes on a chunk; the last two heed case.
CODE_FLAGS = [r"\bUNS\s+[A-Z]\d{5}\b", r"\bASTM\s+[A-Z]\d{2,4}\b", r"\bAPI\s+\d+[A-Z]?\b", r"\bNACE\s+[A-Z]{2}\d{4}\b"]
CODE_FLAGS_CASED = [r"\b[A-Z]{2,4}\s*\d{3,4}[A-Z]?\b", r"\b\d{3}[A-Z]?L?\b"]
TABLE_HEADERS = [
    r"TABLE\s+\d+\s+(?:Chemical|Mechanical|Heat Treatment|Tensile|Hardness)", r"TABLE\s+X?\d+\.?\d*\s+", r"Chemical\s+Requirements", r"Mechanical\s+(?:Properties|Requirements)",
    r"Heat\s+Treatment\s+Requirements", r"Tensile\s+(?:Strength\s+)?(?:and\s+)?(?:Hardness\s+)?Requirements", r"Impact\s+Requirements", r"Dimensions\s+of\s+(?:Welded|Seamless)",
    r"\bUNS\s+Designation\b", r"\bGrade\b.*\bTensile\b.*\bYield\b", r"\bElement\b.*\bGrade\b", r"\bTemperature\b.*\b(?:°F|°C)\b", r"\bSchedule\s+(?:5S|10S|40S|80S)\b",
    r"(?:Carbon|Manganese|Chromium|Nickel|Molybdenum|Nitrogen|Silicon)",
]
FOOTNOTES_CASED = [r"^[A-Z]\s+.{10,}"]
FOOTNOTES = [r"^Note\s*\d*:?\s+", r"^[ᴬᴮᶜᴰᴱᶠᴳᴴᴵᴶᴷᴸᴹᴺᴼᴾᵠᴿˢᵀᵁⱽᵂˣʸᶻ]\s+", r"Maximum,?\s+unless", r"\.\.\.\s*(?:indicates|no\s+requirement)"]
NUMBER_OR_RANGE = r"\d+(?:\.\d+)?(?:\s*[-–]\s*\d+(?:\.\d+)?)?"
DATA_ROW = r"^\s*(?:[SNCGHJKWRT]\d{5}|F\d{2}|[A-Z]\d{3,4}\b|\d+(?:\.\d+)?[%\s])"
TABLE_RULE, BULLET, NUMBERED = r"^[\s|:-]+$", r"^\s*[-•*◦▪]\s+", r"^\s*\d+[.)]\s+"
SECTION_NUMBER = r"(?m)^(?:Section\s+)?(\d+(?:\.\d+)*)\.?:?\s+[A-Z]"
HEADINGS = [(r"(?m)^(\d+\.?\d*)\s+([A-Z][^\n]{3,50})$", 2), (r"(?mi)^(Section\s+\d+:?\s*)([A-Z][^\n]{3,50})$", 2), (r"(?m)^([A-Z][A-Z\s]{3,50})$", 1)]
FULL_REFUSALS = [
    r"I cannot (provide|answer|find|determine|locate)", r"not\s+(available|provided|included|found|present)\s+in\s+(the\s+)?(uploaded|provided|given)", r"unable to (answer|provide|find|determine)",
    r"I don['’]t have (enough|sufficient)\s+information", r"does not contain\b", r"no relevant (data|information|content)", r"not (in|within) the (uploaded|provided) documents",
    r"cannot be determined from", r"not found in the uploaded", r"is not (?:included |covered |addressed )?in (?:the )?(?:uploaded|provided|given)",
]
PARTIAL_REFUSALS = [r"I cannot provide a complete", r"I cannot fully (answer|address)", r"only contains? (information|data) about", r"limited information", r"not all.+(?:available|found|included)"]
REFUSAL_ANSWERS = [r"cannot\s+answer", r"not\s+(?:in|included|provided|found)", r"no\s+(?:information|data|specification)", r"don'?t\s+have", r"not\s+specified", r"outside\s+(?:the\s+)?scope"]
TABLE_CONTENT = [r"(?i)TABLE\s+\d+", r"(?i)\bTABLE\s+[A-Z]\d*", r"(?i)(?:Mechanical|Chemical|Physical)\s+(?:Requirements|Properties)", r"(?i)(?:Grade|Type|Class)\s+(?:Designation|UNS)", r"\b(?:min|max|Min|Max|MIN|MAX)\b.*\b(?:ksi|MPa|%|psi)\b", r"\b\d+(?:\.\d+)?\s*(?:ksi|MPa)\b.*\b\d+(?:\.\d+)?\s*(?:ksi|MPa)\b", r"\|\s*\w+\s*\|", r"\t\s*\d+(?:\.\d+)?\s*\t"]
#: What makes a question simple or complex, what asks for parts, and sections by topic.
COMPLEXITY = {"compares": r"compare|vs\.?|versus|differ", "lists": "list|all|which|what are", "explains": "explain|why|how does|describe", "direct": "what is|yield|tensile|hardness|composition"}
DECOMPOSED = ["compare", "difference", "vs", "versus", "better", "worse", "list", "all", "which", "what are"]
JOINED = r"\band\b|\bor\b"
SECTION_NAMED = r"(?:section|table|clause|annex|appendix)\s+\w+"
SECTION_TOPICS = [
    ("heat\\s*treat", ["heat treatment", "Section 6"]), ("mechanic", ["mechanical properties", "tensile requirements"]), ("chemic", ["chemical composition", "chemical requirements"]),
    ("hardness", ["hardness", "mechanical requirements"]), ("impact|charpy", ["impact test", "supplementary requirements"]), ("scope", ["scope", "Section 1"]),
]
#: Intents in the order in which ties are broken.
INTENTS = {
    "lookup": [r"what\s+is\s+(?:the\s+)?(?:\w+\s+){0,3}(?:of|for)\s+", r"(?:yield|tensile)\s+strength\s+(?:of|for)", r"(?:chemical\s+)?composition\s+(?:of|for)", r"\b(?:nitrogen|chromium|nickel|molybdenum)\s+(?:content|range)", r"heat\s+treatment\s+(?:temperature|for)"],
    "comparison": [r"compare\s+", r"\bvs\.?\b|\bversus\b", r"difference\s+(?:between|in)", r"\bwhich\s+(?:is|has)\s+(?:higher|lower|better|more)", r"\b(?:F\d{2}|S\d{5}|J\d{5})\s+(?:and|vs\.?|,)\s+(?:F\d{2}|S\d{5}|J\d{5})"],
    "synthesis": [r"across\s+(?:all|multiple|different)", r"\ball\s+(?:grades|standards|specifications)", r"summary\s+of", r"combine|combining"],
    "list": [r"list\s+(?:all|the)", r"what\s+(?:are\s+)?(?:all|the)\s+\w+\s+(?:covered|specified)", r"\bwhat\s+UNS\b", r"\bwhich\s+grades\b"],
    "explanation": [r"\bwhat\s+is\s+(?:a\s+)?(?!the\s+\w+\s+of)", r"\bhow\s+(?:does|do|is|are)", r"\bwhy\s+(?:does|do|is|are)", r"explain\s+", r"describe\s+"],
    "verification": [r"does\s+(?:\w+\s+)?meet", r"is\s+(?:\w+\s+)?compliant", r"verify\s+", r"check\s+if"],
}
CLAIM_PROPERTIES = [
    ("yield_strength", ["yield", "ys"]), ("tensile_strength", ["tensile", "uts", "ultimate"]), ("elongation", ["elongation", "elong"]), ("hardness", ["hardness", "hrc", "hbw"]), ("pren", ["pren"]),
    ("impact", ["impact", "charpy"]), ("temperature", ["temperature", "anneal"]), ("composition", ["composition", "carbon", "chromium"]),
]
ERRORS = [
    ("SERVICE_UNAVAILABLE", ["api key", "api_key", "apikey"]), ("RATE_LIMITED", ["rate limit", "quota", "too many"]), ("NOT_FOUND", ["not found", "404", "does not exist"]),
    ("TIMEOUT", ["timeout", "timed out", "econnreset"]), ("SERVICE_UNAVAILABLE", ["econnrefused", "network", "fetch failed"]), ("UNAUTHORIZED", ["unauthorized", "authentication", "401"]),
    ("VALIDATION_ERROR", ["invalid", "validation", "required"]),
]
#: Quantities: pattern, group of the number, group of the unit.
QUANTITIES = [
    (r"(\d+(?:,\d{3})*(?:\.\d+)?)\s*(MPa|ksi|psi|HRC|HRB|HBW|HV|%|°[CF]|mm|in|kJ/m²)", 1, 2),
    (r'(\d+/\d+)\s*("|in|inch)', 1, 2),
    (r"(\d+(?:,\d{3})*(?:\.\d+)?)\s*[-–]\s*(\d+(?:,\d{3})*(?:\.\d+)?)\s*(MPa|ksi|psi|HRC|HBW|%)", 1, 3),
]
#: Measured values: kind, pattern, group of the number, group of the unit.
MEASUREMENTS = [("stress", r"(\d+(?:\.\d+)?)\s*(ksi|MPa)", 1, 2), ("percent", r"(\d+(?:\.\d+)?)\s*(%)", 1, 2), ("temperature", r"(\d+(?:\.\d+)?)\s*°([FC])", 1, 2), ("hardness", r"(\d+(?:\.\d+)?)\s*(HBW|HRC|HRB)", 1, 2)]
FORMULA_ASKED = r"\b(formula|equation|calculation|calculate|compute|derive)\b"
FORMULA_SHOWN = r"=\s*%?\w+\s*[+\-*/]|formula:|equation:|PREN\s*="
#: Ways in which a query names a document, after codes of the catalogue.
NAMED_DOCUMENTS = [
    r"\b(?:per|according\s+to|in|from|spec|specification|under|about|of|ASTM)\s+(A\d{3,4})\b",
    r"\b(A\d{3,4})\s+(?:pipe|tubing|tube|plate|sheet|bar|cast|specification|spec|standard)\b",
    r"\bAPI[\s-]+(?:SPEC(?:IFICATION)?\s+)?(\d{1,2}[A-Z]{1,4})\b",
]
#: Codes in file names (upper case), and the code of a document's name.
FILENAME_ASTM, FILENAME_UNS = r"A\d{3,4}(?![M\d])", r"[SNCGHJKWRT]\d{5}"
FILENAME_API, API_CODE = r"(?:API|SPEC)\s+(\d{1,2}[A-Z]{1,4})\b", r"^\d{1,2}[A-Z]{1,3}$"
SPEC_CODES = [r"(A\d{3,4})(?![M\d])", r"(?:API|SPEC)[\s-]+(?:SPEC\s+)?(\d{1,2}[A-Z]{1,4})", r"(\d{1,2}(?:CT|CRA|[A-Z]))"]
