"""Default dictionaries, code lists, keyword lists and display orders.

Every function that uses one of these takes it as a parameter, so other study questions
pass their own dictionaries.
"""

# Drug classes in display order, upper-case keywords per class.
DRUG_CLASSES = {
    "Calcineurin inhibitors": (
        "TACROLIMUS", "FK506", "PROGRAF", "ADVAGRAF", "CYCLOSPORINE", "NEORAL", "SANDIMMUNE",
    ),
    "mTOR inhibitors": (
        "EVEROLIMUS", "AFINITOR", "CERTICAN", "SIROLIMUS", "RAPAMUNE", "TEMSIROLIMUS", "TORISEL",
    ),
    "Antiproliferative agents": (
        "MYCOPHENOLATE MOFETIL", "CELLCEPT", "MYCOPHENOLIC ACID", "MYFORTIC", "AZATHIOPRINE", "IMURAN",
    ),
    "Corticosteroids": (
        "PREDNISONE", "DELTASONE", "METHYLPREDNISOLONE", "MEDROL", "SOLU-MEDROL", "DEXAMETHASONE",
        "DECADRON", "PREDNISOLONE",
    ),
    "Biologics": (
        "RITUXIMAB", "MABTHERA", "RITUXAN", "BASILIXIMAB", "SIMULECT", "BELATACEPT", "NULOJIX",
    ),
}

# Molecule name and its synonyms, training source.
TRAINING_MOLECULES = {
    "tacrolimus": ("TACROLIMUS", "FK506", "PROGRAF", "ADVAGRAF"),
    "cyclosporine": ("CYCLOSPORINE", "NEORAL", "SANDIMMUNE"),
    "mmf": ("MYCOPHENOLATE MOFETIL", "CELLCEPT"),
    "mpa": ("MYCOPHENOLIC ACID", "MYFORTIC"),
    "azathioprine": ("AZATHIOPRINE", "IMURAN"),
}

# Molecule name and its synonyms, external validation.
VALIDATION_MOLECULES = {
    "cyclosporine": ("CYCLOSPORINE", "NEORAL", "SANDIMMUNE"),
    "mmf": ("MYCOPHENOLATE MOFETIL", "CELLCEPT"),
    "mpa": ("MYCOPHENOLIC ACID", "MYFORTIC"),
    "azathioprine": ("AZATHIOPRINE", "IMURAN"),
}

# Molecules described in the second source.
DESCRIBED_MOLECULES = ("CYCLOSPORINE", "TACROLIMUS", "MYCOPHENOLATE MOFETIL", "AZATHIOPRINE")

# Outcome term codes and names.
OUTCOME_TERMS = {
    10001580: "Albuminuria",
    10002847: "Anuria",
    10005483: "Blood creatinine increased",
    10018358: "Glomerular filtration rate decreased",
    10018867: "Haematuria",
    10027525: "Microalbuminuria",
    10029155: "Nephropathy toxic",
    10030302: "Oliguria",
    10037032: "Proteinuria",
    10038428: "Renal disorder",
    10038435: "Renal failure",
    10061480: "Renal function test abnormal",
    10062237: "Renal impairment",
    10062747: "Hypercreatininaemia",
    10064848: "Chronic kidney disease",
    10069339: "Acute kidney injury",
}

# Indication keywords, checked in this group order.
TRANSPLANT_WORDS = (
    "TRANSPLANT", "TRANSPLANTATION", "GRAFT", "RENAL TRANSPLANT", "KIDNEY TRANSPLANT",
    "HEART TRANSPLANT", "LIVER TRANSPLANT", "PANCREAS TRANSPLANT", "BONE MARROW TRANSPLANT",
    "HSCT", "SCT",
)
AUTOIMMUNE_WORDS = (
    "SYSTEMIC LUPUS", "LUPUS", "SLE", "RHEUMATOID ARTHRITIS", "RA", "PSORIASIS", "PSORIATIC",
    "ANKYLOSING SPONDYLITIS", "CROHN", "ULCERATIVE COLITIS", "IBD", "INFLAMMATORY BOWEL",
    "VASCULITIS", "ANCA", "MULTIPLE SCLEROSIS", "MYASTHENIA", "SJOGREN", "SCLERODERMA",
    "DERMATOMYOSITIS", "POLYMYOSITIS", "AUTOIMMUNE", "IGA NEPHROPATHY", "LUPUS NEPHRITIS",
)

# Level orders and labels.
SUSPECT_ROLES = ("PS", "SS")
AGE_LEVELS = ("<18", "18-39", "40-64", "65+")
INDICATION_LEVELS = ("Other", "Transplantation", "Autoimmune diseases")
SERIOUS_LEVELS = ("Serious", "Non-serious")
REGION_LEVELS = ("US", "EUROPE", "JAPAN", "CHINA", "OTHER")
TERM_LEVELS = ("SOC", "HLGT", "HLT", "PT")
RISK_CUTS = (0.02, 0.05)
RISK_LABELS = ("Low", "Moderate", "High")

# Age unit spellings and how many of them make one year.
AGE_UNITS = (
    (("", "YR", "YRS", "YEAR", "YEARS"), 1.0),
    (("MON", "MONTH", "MONTHS"), 12.0),
    (("WK", "WEEK", "WEEKS"), 52.0),
    (("DY", "DAY", "DAYS"), 365.25),
    (("DEC", "DECADE"), 0.1),
)

# Sex spellings.
FEMALE_WORDS = ("F", "FEMALE", "2")
MALE_WORDS = ("M", "MALE", "1")

# Onset bins, upper bound in days.
ONSET_BINS = ((7, "0-7d"), (30, "8-30d"), (90, "31-90d"), (365, "91-365d"))
ONSET_LAST = ">365d"
ONSET_MISSING = "Missing"
