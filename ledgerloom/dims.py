"""Report dimensions: categories, text rules, worksheet lines.

Everything here is small, fixed data.  The ``*_frame`` helpers expose it as DataFrames so
that ledgers can be joined or inspected against it; column expressions elsewhere in the
package use the Python rows directly, which lets Catalyst fold them into literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TRANSFER = "Internal Account Transfer"
OTHER_REVENUE = "Other Revenue"
OTHER_EXPENSES = "Other Expenses"
NOT_APPLICABLE = "N/A"

# --- fixed values: category names, in report order -------------------------------------
REVENUE_CATEGORIES = (
    "Donations & Contributions",
    "Donations & Contributions: Tournament Sponsor",
    "Donations & Contributions: Employer Match",
    "Grants",
    "Program Service Revenue",
    "Program Service Revenue: Dirty Bird Tournament",
    "Program Service Revenue: Skills & Drills",
    "Investment Income",
    "Fundraising Event Revenue",
    OTHER_REVENUE,
)

EXPENSE_CATEGORIES = (
    "Program Services",
    "Program Services: Dirty Birds Tournament",
    "Program Services: Travel Tournament",
    "Program Services: Skills & Drills",
    "Management & General",
    "Fundraising",
    "Facilities & Occupancy",
    "Salaries & Benefits",
    "Supplies & Materials",
    "League Equipment",
    "Travel & Transportation",
    "Professional Services",
    "Insurance",
    "Scholarship",
    TRANSFER,
    OTHER_EXPENSES,
)

FUNCTIONS = ("Program Services", "Management & General", "Fundraising")
DEFAULT_FUNCTION = "Management & General"

# --- fixed values: functional class per expense category (others: DEFAULT_FUNCTION) ----
FUNCTION_OF = {
    "Program Services": "Program Services",
    "Program Services: Dirty Birds Tournament": "Program Services",
    "Program Services: Travel Tournament": "Program Services",
    "Program Services: Skills & Drills": "Program Services",
    "Salaries & Benefits": "Program Services",
    "Supplies & Materials": "Program Services",
    "League Equipment": "Program Services",
    "Travel & Transportation": "Program Services",
    "Scholarship": "Program Services",
    "Fundraising": "Fundraising",
    TRANSFER: NOT_APPLICABLE,
}

# --- fixed values: text rules ----------------------------------------------------------
# Regular expressions searched anywhere in the lower-cased description.  Row order is the
# rule priority: the first row that matches decides.
TRANSFER_RULE = (
    r"transfer\s+(?:from|to)|internet\s+transfer|new\s+account\s+deposit|funds\s+transfe"
    r"|acctverify|verifybank"
)
PAYMENT_APP_RULE = r"venmo\s+.*payment|payment.*venmo"
PAYMENT_APP_CATEGORY = "Program Services"

CATEGORY_RULES = (
    ("Donations & Contributions",
     r"donat|contribut|tithe|offering|gift|pledge|charit|philanthropi|benevo"
     r"|mobile\s+deposit|descriptive\s+deposit"),
    ("Grants",
     r"grant|award|foundation\s+(?:fund|pay)|government\s+fund|federal\s+fund|state\s+fund"),
    ("Program Service Revenue",
     r"program\s+fee|tuition|registration|enrollment|service\s+fee|membership\s+due"
     r"|membership\s+fee|class\s+fee|workshop\s+fee|training\s+fee|venmo\s+.*cashout"
     r"|cashout\s+.*deposit|zelle.*(?:payment|deposit)|paypal.*(?:transfer|deposit)"),
    ("Investment Income",
     r"interest\s+(?:income|earned|payment)|dividend|investment|capital\s+gain|yield"
     r"|interest\s+from"),
    ("Fundraising Event Revenue",
     r"fundrais|gala|auction|benefit\s+dinner|raffle|ticket\s+sale|event\s+revenue"),
    ("Salaries & Benefits",
     r"payroll|salary|salaries|wage|compensation|benefit|health\s+ins|dental|retirement"
     r"|401k|pension|worker.?s?\s+comp|adp|gusto|paychex|direct\s+deposit"),
    ("Facilities & Occupancy",
     r"rent|lease|mortgage|utilit|electric|gas\s+bill|water\s+bill|internet|phone\s+bill"
     r"|maintenance|repair|janitorial|cleaning|property\s+tax|landscap"
     r"|ice\s+(?:rink|arena|sport|center)|sno\s+king|ice\s+sport"
     r"|skating\s+(?:rink|center|arena)|field\s+(?:rental|reserv)|gym\s+(?:rental|fee)"
     r"|court\s+(?:rental|fee)|venue\s+(?:rental|fee)"),
    ("Supplies & Materials",
     r"supply|supplies|material|office\s+depot|staples|amazon|walmart|target|paper|ink|toner"
     r"|dollar\s*tree|fedex\s+offic|fedex\s+office|ups\s+store|kinkos"),
    ("League Equipment",
     r"hockeytron|hockey\s*monkey|pure\s*hockey|dick.?s\s+sport|sport\s*check|equipment|gear"
     r"|jersey|jerseys|uniform|puck|stick|skate|helmet|glove|pad\b|pads\b|protective|net\b"
     r"|goal\s+equip"),
    ("Travel & Transportation",
     r"travel|flight|airfare|airline|hotel|lodging|uber|lyft|taxi|mileage|gas\s+station|fuel"
     r"|parking|toll"),
    ("Professional Services",
     r"legal|attorney|lawyer|accounting|audit|consult|contractor|freelanc|design\s+serv"
     r"|marketing\s+serv|advisory|cpa"),
    ("Insurance",
     r"insurance|liability|coverage|premium|policy\s+(?:pay|renew)|indemnity"),
    ("Fundraising",
     r"fundrais(?:ing)?\s+(?:expense|cost|supply)|donor\s+manag|campaign|solicitation"
     r"|appeal\s+mail|event\s+(?:cost|expense|decor|cater)"),
    ("Management & General",
     r"admin|management\s+fee|bank\s+(?:fee|charge|service)|license|permit|filing\s+fee"
     r"|registration\s+fee|software\s+(?:sub|license)|quickbooks|xero|subscription|dues"
     r"|postage|shipping|google\s*\*|google\s+one|microsoft|adobe|intuit"
     r"|square\s+(?:fee|service)|monthly\s+(?:fee|charge|service)"),
    ("Program Services",
     r"program\s+(?:expense|cost|supply|material)|curriculum|workshop\s+(?:expense|cost)"
     r"|participant|client\s+serv|outreach|community\s+serv|mission"
     r"|league\s+(?:fee|due|registr)|(?:team|player)\s+(?:fee|registr)|referee|winterhawk"
     r"|cascade\s+athletic|seattle\s+women|spo\*seattle|usa\s+hockey"
     r"|game\s+(?:fee|official|ice)"),
    ("Program Services: Dirty Birds Tournament",
     r"dirty\s*bird|dirty\s*birds\s*(?:tourn|event|fee)"),
    ("Program Services: Travel Tournament",
     r"travel\s+tourn|away\s+tourn|road\s+tourn|tournament\s+travel|tournament\s+entry"
     r"|tournament\s+(?:fee|registr)|tournament"),
    ("Program Services: Skills & Drills",
     r"skills?\s*(?:&|and)\s*drills?|skills?\s+clinic|drills?\s+session|skills?\s+training"
     r"|practice\s+session"),
    ("Program Service Revenue: Dirty Bird Tournament",
     r"dirty\s*bird|dirty\s*birds?\s*(?:tourn|registr|entry|fee)"),
    ("Program Service Revenue: Skills & Drills",
     r"skills?\s*(?:&|and)\s*drills?|skills?\s+(?:clinic|class|session)\s+(?:fee|revenue|income)"),
    ("Donations & Contributions: Tournament Sponsor",
     r"(?:tourn|event)\s*sponsor|sponsor.*(?:tourn|event)|sponsorship"),
    ("Donations & Contributions: Employer Match",
     r"employer\s+match|company\s+match|corporate\s+match"
     r"|matching\s+(?:gift|donat|contribut|fund)|benevity|yourcause|double\s+the\s+donat"),
    ("Scholarship",
     r"scholar|financial\s+aid|player\s+assist|tuition\s+assist|need.based\s+(?:aid|assist)"),
)

# --- fixed values: Part IX expense lines -> categories (exact names) --------------------
EXPENSE_LINES = (
    ("1_grants_to_domestic_orgs", ()),
    ("2_grants_to_domestic_individuals", ()),
    ("3_grants_to_foreign", ()),
    ("4_benefits_to_members", ()),
    ("5_compensation_current_officers", ("Salaries & Benefits",)),
    ("6_compensation_disqualified", ()),
    ("7_other_salaries", ()),
    ("8_pension_plans", ()),
    ("9_other_employee_benefits", ()),
    ("10_payroll_taxes", ()),
    ("11a_management_fees", ("Professional Services",)),
    ("11b_legal_fees", ()),
    ("11c_accounting_fees", ()),
    ("11d_lobbying_fees", ()),
    ("11e_professional_fundraising", ()),
    ("11f_investment_management", ()),
    ("11g_other_fees", ()),
    ("12_advertising", ()),
    ("13_office_expenses", ("Supplies & Materials",)),
    ("14_information_technology", ("Management & General",)),
    ("15_royalties", ()),
    ("16_occupancy", ("Facilities & Occupancy",)),
    ("17_travel", ("Travel & Transportation",)),
    ("18_third_party_payments", ()),
    ("19_other_expenses_a", ("Program Services", "League Equipment")),
    ("19_other_expenses_b", ("Fundraising",)),
    ("19_other_expenses_c", ("Insurance",)),
    ("19_other_expenses_d", (OTHER_EXPENSES,)),
)


def parent_of(category: str) -> str:
    """Category a sub-category folds into; sub-categories are named ``Parent: Detail``."""
    return category.split(": ", 1)[0]


def kind_of(category: str) -> str:
    if category == TRANSFER:
        return "Transfer"
    return "Revenue" if category in REVENUE_CATEGORIES else "Expense"


def function_of(category: str) -> str:
    if category in REVENUE_CATEGORIES:
        return NOT_APPLICABLE
    return FUNCTION_OF.get(category, DEFAULT_FUNCTION)


def with_subcategories(*names: str) -> list[str]:
    """The named categories plus every sub-category folding into one of them."""
    return [c for c in REVENUE_CATEGORIES + EXPENSE_CATEGORIES
            if c in names or parent_of(c) in names]


def category_frame(spark: SparkSession) -> DataFrame:
    rows = [(c, kind_of(c), i, parent_of(c), function_of(c))
            for i, c in enumerate(REVENUE_CATEGORIES + EXPENSE_CATEGORIES)]
    return spark.createDataFrame(
        rows, "category string, kind string, ord int, parent string, functional string")


def rule_frame(spark: SparkSession) -> DataFrame:
    rules = [(TRANSFER, TRANSFER_RULE), (PAYMENT_APP_CATEGORY, PAYMENT_APP_RULE),
             *CATEGORY_RULES]
    return spark.createDataFrame(
        [(i, c, r) for i, (c, r) in enumerate(rules)],
        "priority int, category string, regex string")


def expense_line_frame(spark: SparkSession) -> DataFrame:
    rows = [(key, i, category)
            for i, (key, categories) in enumerate(EXPENSE_LINES)
            for category in (categories or (None,))]
    return spark.createDataFrame(rows, "line_key string, ord int, category string")
