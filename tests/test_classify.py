import pytest
from pyspark.sql import functions as F

from ledgerloom import dims
from ledgerloom.functions import classify

CASES = [
    ("dirty bird entry", 1, "Other Revenue"),
    ("skills & drills", 1, "Other Revenue"),
    ("skills class revenue", 1, "Program Service Revenue: Skills & Drills"),
    ("tournament sponsor", 1, "Other Revenue"),
    ("event sponsor", 1, "Donations & Contributions: Tournament Sponsor"),
    ("matching gift", 1, "Donations & Contributions"),
    ("fundraising expense", -1, "Other Expenses"),
    ("registration fee", -1, "Other Expenses"),
    ("tuition assist", -1, "Other Expenses"),
    ("tournament travel", -1, "Travel & Transportation"),
    ("direct deposit", 1, "Other Revenue"),
    ("parent meeting", -1, "Facilities & Occupancy"),
    ("internet transfer", 1, "Internal Account Transfer"),
    ("internet transfer", -1, "Internal Account Transfer"),
    ("", 1, "Other Revenue"),
    ("", -1, "Other Expenses"),
    (None, -1, "Other Expenses"),
    ("nothing known", 0, "Other Expenses"),
    ("DONATION from Ann", 1, "Donations & Contributions"),
    ("donation", 0, "Other Expenses"),
    ("venmo team payment", -1, "Program Services"),
    ("payment to venmo", -1, "Program Services"),
    ("venmo team payment", 1, "Other Revenue"),
    ("zelle from bob payment", 1, "Program Service Revenue"),
    ("mobile deposit", 1, "Donations & Contributions"),
    ("zelle\npayment", 1, "Other Revenue"),
    ("shoulder pad", -1, "League Equipment"),
    ("shoulder padding", -1, "Other Expenses"),
    ("net 30", -1, "League Equipment"),
    ("netto", -1, "Other Expenses"),
    ("google *cloud", -1, "Management & General"),
    ("spo*seattle", -1, "Program Services"),
    ("team fee", -1, "Program Services"),
    ("workers comp", -1, "Salaries & Benefits"),
    ("need-based aid", -1, "Scholarship"),
    ("corporate match", 1, "Donations & Contributions: Employer Match"),
]


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, d, float(a)) for i, (d, a, _) in enumerate(CASES)]
    return spark.createDataFrame(rows, "i int, description string, amount double")


def test_rules(frame):
    found = {r.i: r.category for r in classify.classify(frame).collect()}
    wrong = [(CASES[i], found[i]) for i in range(len(CASES)) if found[i] != CASES[i][2]]
    assert not wrong and len(found) == len(CASES)


def test_guarded_rules_equal_plain_search(spark):
    """Splitting rules into words and patterns must not change what they match."""
    words = sorted({w for _, rule in dims.CATEGORY_RULES for a in classify._SPLIT.split(rule)
                    for w in [a.replace(r"\s+", " ").replace(r"\s*", "").replace("?", "")
                              .replace("(:", "(").replace("\\", "")] if w})
    texts = [f"{a} {b}" for a in words[::3] for b in words[1::7]] + words
    df = spark.createDataFrame([(t,) for t in texts], "_text string")
    for _, rule in dims.CATEGORY_RULES:
        split = F.expr(classify._matches(rule))
        plain = F.col("_text").rlike("(?dU)" + rule)
        assert df.where(split != plain).isEmpty(), rule


def test_dimensions(spark):
    rows = {r.category: r for r in dims.category_frame(spark).collect()}
    assert len(rows) == 26
    assert rows["Scholarship"].functional == "Program Services"
    assert rows["Insurance"].functional == "Management & General"
    assert rows["Internal Account Transfer"].functional == "N/A"
    assert rows["Internal Account Transfer"].kind == "Transfer"
    assert rows["Program Services: Skills & Drills"].parent == "Program Services"
    assert rows["Grants"].functional == "N/A" and rows["Grants"].kind == "Revenue"
    assert dims.rule_frame(spark).count() == 25
    assert dims.expense_line_frame(spark).where("category IS NULL").count() == 18
    unknown = spark.createDataFrame([("Made Up",)], "category string")
    row = classify.with_dimensions(unknown).first()
    assert (row.functional, row.category_type) == ("Management & General", "Expense")
