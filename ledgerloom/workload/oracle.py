"""The registered queries as plain SQL for another engine.

Written independently of the DataFrame code: direct aggregation per report line, no shared
summary.  Only names and rule texts come from the dimension data.
"""

from __future__ import annotations

from ledgerloom import dims
from ledgerloom.workload import intake
from ledgerloom.workload.ledger import ledger_sql
from ledgerloom.workload.queries import amount_text_sql

CASH, ASSETS, LIABILITIES, NET_ASSETS = 10000, 2500, 1200, 5000


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(names) -> str:
    return "(" + ", ".join(q(n) for n in names) + ")"


def _category_case() -> str:
    text = "lower(description)"
    branches = [
        f"WHEN regexp_matches({text}, {q(dims.TRANSFER_RULE)}) THEN {q(dims.TRANSFER)}",
        f"WHEN amount <= 0 AND regexp_matches({text}, {q(dims.PAYMENT_APP_RULE)}) "
        f"THEN {q(dims.PAYMENT_APP_CATEGORY)}",
    ]
    for name, rule in dims.CATEGORY_RULES:
        revenue = name in dims.REVENUE_CATEGORIES
        plus = name if revenue else dims.OTHER_REVENUE
        minus = dims.OTHER_EXPENSES if revenue else name
        branches.append(f"WHEN regexp_matches({text}, {q(rule)}) "
                        f"THEN CASE WHEN amount > 0 THEN {q(plus)} ELSE {q(minus)} END")
    fallback = (f"CASE WHEN amount > 0 THEN {q(dims.OTHER_REVENUE)} "
                f"ELSE {q(dims.OTHER_EXPENSES)} END")
    return "CASE " + "\n ".join(branches) + f" ELSE {fallback} END"


def _functional_case(column: str = "category") -> str:
    program = [c for c, f in dims.FUNCTION_OF.items() if f == "Program Services"]
    return (f"CASE WHEN {column} IN {in_list(dims.REVENUE_CATEGORIES)} THEN 'N/A' "
            f"WHEN {column} IN {in_list(program)} THEN 'Program Services' "
            f"WHEN {column} = 'Fundraising' THEN 'Fundraising' "
            f"WHEN {column} = {q(dims.TRANSFER)} THEN 'N/A' ELSE 'Management & General' END")


def _type_case(column: str = "category") -> str:
    return (f"CASE WHEN {column} = {q(dims.TRANSFER)} THEN 'Transfer' "
            f"WHEN {column} IN {in_list(dims.REVENUE_CATEGORIES)} THEN 'Revenue' "
            f"ELSE 'Expense' END")


LEDGER = f"WITH ledger AS (\n{ledger_sql()}\n)"
CLASSIFIED = (
    f"{LEDGER},\npairs AS (SELECT DISTINCT description, amount > 0 AS up, "
    f"CASE WHEN amount > 0 THEN 1 ELSE -1 END AS amount FROM ledger),\n"
    f"decided AS (SELECT description, up, {_category_case()} AS category FROM pairs),\n"
    f"classified AS (SELECT l.*, d.category, {_functional_case('d.category')} AS functional, "
    f"{_type_case('d.category')} AS category_type FROM ledger l "
    f"JOIN decided d ON l.description = d.description AND (l.amount > 0) = d.up)"
)
MONEY = "CAST(ROUND({0}, 2) AS DOUBLE)"
NOT_TRANSFER = f"category <> {q(dims.TRANSFER)}"
DAY = "CAST(txn_ts AS DATE) AS txn_date"


def money(expression: str) -> str:
    return f"CAST(ROUND(COALESCE({expression}, 0), 2) AS DOUBLE)"


def _exact(expression: str) -> str:
    return f"ROUND(COALESCE({expression}, 0), 2)"


def _sum_in(categories, column: str = "amount", sign: str = "> 0") -> str:
    return (f"ABS(COALESCE(SUM({column}) FILTER (WHERE category IN {in_list(categories)} "
            f"AND amount {sign}), 0))")


def _listed(names) -> str:
    return ", ".join(f"({i}, {q(n)})" for i, n in enumerate(names))


SPENDING = [c for c in dims.EXPENSE_CATEGORIES if c != dims.TRANSFER]

_ACTIVITY = CLASSIFIED + f""",
per_category AS (SELECT category, SUM(amount) AS net FROM classified GROUP BY category),
revenue AS (SELECT o, c, ROUND(net, 2) AS v, net FROM (VALUES {_listed(dims.REVENUE_CATEGORIES)}) t(o, c)
  JOIN per_category ON category = c),
expense AS (SELECT o, c, ROUND(ABS(net), 2) AS v, net FROM (VALUES {_listed(SPENDING)}) t(o, c)
  JOIN per_category ON category = c),
sums AS (SELECT (SELECT COALESCE(SUM(v), 0) FROM revenue) AS tr,
  (SELECT COALESCE(SUM(v), 0) FROM expense) AS te,
  (SELECT COALESCE(SUM(ROUND(net, 2)), 0) FROM per_category WHERE category = {q(dims.TRANSFER)}) AS nt),
activity_lines AS (
  SELECT 'revenue' AS section, o AS ord, c AS line_key, c AS label, v AS amount, FALSE AS is_total
    FROM revenue WHERE net <> 0
  UNION ALL SELECT 'revenue', 10, 'total_revenue', 'Total Revenue and Support', tr, TRUE FROM sums
  UNION ALL SELECT 'expenses', 11 + o, c, c, v, FALSE FROM expense WHERE net <> 0
  UNION ALL SELECT 'expenses', 26, 'total_expenses', 'Total Expenses', te, TRUE FROM sums
  UNION ALL SELECT 'transfers', 27, 'net_transfers', 'Net Transfers', nt, FALSE FROM sums
  UNION ALL SELECT 'change', 28, 'change_in_net_assets', 'Change in Net Assets', tr - te + nt, TRUE
    FROM sums)"""

_POSITION = LEDGER + f""",
cash AS (SELECT {CASH} + ROUND(SUM(amount), 2) AS c FROM ledger),
position_lines AS (
  SELECT 'assets' AS section, 'Cash and Cash Equivalents' AS label, c AS amount FROM cash
  UNION ALL SELECT 'assets', 'Other Assets', {ASSETS}
  UNION ALL SELECT 'assets', 'Total Assets', c + {ASSETS} FROM cash
  UNION ALL SELECT 'liabilities', 'Total Liabilities', {LIABILITIES}
  UNION ALL SELECT 'net_assets', 'Without Donor Restrictions', c + {ASSETS} - {LIABILITIES} FROM cash
  UNION ALL SELECT 'net_assets', 'With Donor Restrictions', 0
  UNION ALL SELECT 'net_assets', 'Total Net Assets', c + {ASSETS} - {LIABILITIES} FROM cash
  UNION ALL SELECT 'total', 'Total Liabilities and Net Assets', c + {ASSETS} FROM cash)"""

NATURAL = [c for c in SPENDING if c not in dims.FUNCTIONS]
_FUNCTIONAL = CLASSIFIED + f""",
spent AS (SELECT category, functional, SUM(-amount) AS v FROM classified
  WHERE amount < 0 AND {NOT_TRANSFER} GROUP BY category, functional),
cells AS (SELECT o AS ord, CASE WHEN o >= {len(NATURAL)} THEN CONCAT(c, ' (Direct)') ELSE c END AS label,
    SUM(CASE WHEN functional = 'Program Services' THEN ROUND(v, 2) ELSE 0 END) AS p,
    SUM(CASE WHEN functional = 'Management & General' THEN ROUND(v, 2) ELSE 0 END) AS m,
    SUM(CASE WHEN functional = 'Fundraising' THEN ROUND(v, 2) ELSE 0 END) AS f
  FROM (VALUES {_listed([*NATURAL, *dims.FUNCTIONS])}) t(o, c) JOIN spent ON category = c
  GROUP BY o, c),
functional_rows AS (
  SELECT ord, label, p, m, f FROM cells WHERE p + m + f > 0
  UNION ALL SELECT {len(NATURAL) + 3}, 'Total Expenses', COALESCE(SUM(p), 0), COALESCE(SUM(m), 0),
    COALESCE(SUM(f), 0) FROM cells)"""

_CASH = CLASSIFIED + f""",
per_category AS (SELECT category, SUM(amount) AS net FROM classified GROUP BY category),
inflow AS (SELECT o, c, ROUND(net, 2) AS v FROM (VALUES {_listed(dims.REVENUE_CATEGORIES)}) t(o, c)
  JOIN per_category ON category = c WHERE net > 0),
outflow AS (SELECT o, c, -ROUND(ABS(net), 2) AS v FROM (VALUES {_listed(SPENDING)}) t(o, c)
  JOIN per_category ON category = c WHERE net <> 0),
flow AS (SELECT (SELECT COALESCE(SUM(v), 0) FROM inflow) + (SELECT COALESCE(SUM(v), 0) FROM outflow) AS n),
cash_lines AS (
  SELECT 'operating' AS section, o AS ord, CONCAT('Cash received from ', lower(c)) AS label, v AS amount FROM inflow
  UNION ALL SELECT 'operating', 10 + o, CONCAT('Cash paid for ', lower(c)), v FROM outflow
  UNION ALL SELECT 'operating', 25, 'Net Cash from Operating Activities', n FROM flow
  UNION ALL SELECT 'investing', 26, 'Net Cash from Investing Activities', 0
  UNION ALL SELECT 'financing', 27, 'Net Cash from Financing Activities', 0
  UNION ALL SELECT 'cash', 28, 'Net Change in Cash', n FROM flow
  UNION ALL SELECT 'cash', 29, 'Beginning Cash Balance', {CASH}
  UNION ALL SELECT 'cash', 30, 'Ending Cash Balance', {CASH} + n FROM flow)"""


def _joined(*chains: str) -> str:
    """WITH chains sharing their leading tables; ledger tables are taken once."""
    tables = [CLASSIFIED]
    for chain in chains:
        tables.append(chain[len(CLASSIFIED if chain.startswith(CLASSIFIED) else LEDGER):])
    return "".join(tables)


def _all_statements() -> str:
    cash_chain = _CASH.replace("per_category AS", "per_category_c AS").replace(
        "JOIN per_category ON", "JOIN per_category_c ON")
    functional = " UNION ALL ".join(
        f"SELECT 'functional_expenses', '{name}', {expr} FROM functional_rows"
        for name, expr in (("program_services", "p"), ("management_general", "m"),
                           ("fundraising", "f"), ("total", "p + m + f")))
    return _joined(_ACTIVITY, _POSITION, _FUNCTIONAL, cash_chain) + f""",
every_line AS (SELECT 'activities' AS statement, section, amount FROM activity_lines
  UNION ALL SELECT 'position', section, amount FROM position_lines
  UNION ALL {functional}
  UNION ALL SELECT 'cash_flows', section, amount FROM cash_lines)
SELECT statement, section, COUNT(*) AS n, {MONEY.format('SUM(amount)')} AS amount
FROM every_line GROUP BY statement, section"""


DONATIONS = dims.with_subcategories("Donations & Contributions")
PROGRAM = dims.with_subcategories("Program Service Revenue")

_PART1 = CLASSIFIED + f""",
p AS (SELECT
  {_exact(_sum_in([*DONATIONS, "Grants"]))} AS contributions,
  {_exact(_sum_in(PROGRAM))} AS program,
  {_exact(_sum_in(["Investment Income"]))} AS investment,
  {_exact(_sum_in(["Fundraising Event Revenue", "Other Revenue"]))} AS other,
  {_exact(_sum_in(["Salaries & Benefits"], sign="< 0"))} AS salaries,
  {_exact(f"SUM(-amount) FILTER (WHERE amount < 0 AND {NOT_TRANSFER})")} AS expenses
  FROM classified),
t AS (SELECT *, contributions + program + investment + other AS revenue FROM p),
part1_lines AS (
  SELECT 'line_1' AS line_key, contributions AS amount FROM t
  UNION ALL SELECT 'line_2', program FROM t
  UNION ALL SELECT 'line_3', investment FROM t
  UNION ALL SELECT 'line_4', other FROM t
  UNION ALL SELECT 'line_5_to_9', 0
  UNION ALL SELECT 'line_12', revenue FROM t
  UNION ALL SELECT 'line_13', 0
  UNION ALL SELECT 'line_14', 0
  UNION ALL SELECT 'line_15', salaries FROM t
  UNION ALL SELECT 'line_16a', 0
  UNION ALL SELECT 'line_16b', 0
  UNION ALL SELECT 'line_17', expenses FROM t
  UNION ALL SELECT 'line_18', expenses FROM t
  UNION ALL SELECT 'line_19', revenue - expenses FROM t
  UNION ALL SELECT 'line_20', {NET_ASSETS}
  UNION ALL SELECT 'line_21', 0
  UNION ALL SELECT 'line_22', {NET_ASSETS} + revenue - expenses FROM t)"""

_BY_DESCRIPTION = CLASSIFIED + """,
by_description AS (SELECT description, SUM(amount) AS v FROM classified
  WHERE category = 'Program Service Revenue' AND amount > 0 GROUP BY description),
by_label AS (SELECT substr(description, 1, 50) AS description, ROUND(SUM(v), 2) AS amount
  FROM by_description GROUP BY substr(description, 1, 50))"""

_PART8 = _BY_DESCRIPTION + f""",
v AS (SELECT
  {_exact(_sum_in(DONATIONS))} AS gifts, {_exact(_sum_in(["Grants"]))} AS grants,
  {_exact(_sum_in(["Investment Income"]))} AS investment,
  {_exact(_sum_in(["Fundraising Event Revenue"]))} AS events,
  {_exact(_sum_in(["Fundraising"], sign="< 0"))} AS costs,
  {_exact(_sum_in(["Other Revenue"]))} AS other,
  (SELECT COALESCE(SUM(amount), 0) FROM by_label) AS program FROM classified),
part8_lines AS (
  SELECT line_key, 0 AS amount FROM (VALUES ('1a_federated_campaigns'), ('1b_membership_dues'),
    ('1c_fundraising_events'), ('1d_related_organizations'),
    ('4_income_from_investment_of_tax_exempt_bonds'), ('5_royalties'), ('6a_gross_rents'),
    ('7a_gross_from_sales'), ('9a_gaming_gross'), ('10a_gross_sales_of_inventory')) z(line_key)
  UNION ALL SELECT '1e_govt_grants', grants FROM v
  UNION ALL SELECT '1f_all_other_contributions', gifts FROM v
  UNION ALL SELECT '1h_total_contributions', gifts + grants FROM v
  UNION ALL SELECT '2a_total', program FROM v
  UNION ALL SELECT '3_investment_income', investment FROM v
  UNION ALL SELECT '8a_fundraising_events_gross', events FROM v
  UNION ALL SELECT '8b_fundraising_expenses', costs FROM v
  UNION ALL SELECT '8c_fundraising_net', events - costs FROM v
  UNION ALL SELECT '11_other_revenue', other FROM v
  UNION ALL SELECT '12_total_revenue',
    gifts + grants + program + investment + events - costs + other FROM v)"""

_LINE_VALUES = ", ".join(
    f"({i}, {q(key)}, {q(c) if c else 'NULL'})"
    for i, (key, categories) in enumerate(dims.EXPENSE_LINES) for c in (categories or (None,)))
_PART9 = CLASSIFIED + f""",
spent9 AS (SELECT category, functional, SUM(-amount) AS v FROM classified
  WHERE amount < 0 AND {NOT_TRANSFER} GROUP BY category, functional),
part9_cells AS (SELECT o AS ord, k AS line_key,
    COALESCE(SUM(ROUND(v, 2)) FILTER (WHERE functional = 'Program Services'), 0) AS p,
    COALESCE(SUM(ROUND(v, 2)) FILTER (WHERE functional = 'Management & General'), 0) AS m,
    COALESCE(SUM(ROUND(v, 2)) FILTER (WHERE functional = 'Fundraising'), 0) AS f
  FROM (VALUES {_LINE_VALUES}) t(o, k, c) LEFT JOIN spent9 ON category = c GROUP BY o, k),
part9_rows AS (SELECT * FROM part9_cells
  UNION ALL SELECT {len(dims.EXPENSE_LINES)}, '25_total', SUM(p), SUM(m), SUM(f) FROM part9_cells)"""

_ZERO_ASSETS = ("2_savings", "3_pledges_receivable", "4_accounts_receivable", "5_loans_receivable",
                "6_loans_receivable_other", "7_inventories", "8_prepaid_expenses",
                "10a_land_buildings", "10b_less_depreciation", "10c_net_land_buildings",
                "11_investments_public", "13_program_related_investments", "14_intangible_assets",
                "15_other_assets")
_ZERO_LIABILITIES = ("17_accounts_payable", "18_grants_payable", "19_deferred_revenue",
                     "20_tax_exempt_bond_liabilities", "21_escrow_account",
                     "22_loans_from_officers", "23_secured_mortgages", "24_unsecured_notes")
_ZERO_NET = ("28_temporarily_restricted", "29_permanently_restricted", "30_capital_stock",
             "31_paid_in_capital", "32_retained_earnings")


def _zeros(section: str, keys) -> str:
    return " UNION ALL ".join(f"SELECT {q(section)}, {q(k)}, 0" for k in keys)


_PART10 = CLASSIFIED + f""",
x AS (SELECT {CASH} + ROUND(SUM(amount), 2) AS cash,
  {NET_ASSETS} + ROUND(COALESCE(SUM(amount) FILTER (WHERE {NOT_TRANSFER}), 0), 2) AS na FROM classified),
part10_lines AS (
  SELECT 'assets' AS section, '1_cash' AS line_key, cash AS amount FROM x
  UNION ALL {_zeros('assets', _ZERO_ASSETS)}
  UNION ALL SELECT 'assets', '12_investments_other', {ASSETS}
  UNION ALL SELECT 'assets', '16_total_assets', cash + {ASSETS} FROM x
  UNION ALL {_zeros('liabilities', _ZERO_LIABILITIES)}
  UNION ALL SELECT 'liabilities', '25_other_liabilities', {LIABILITIES}
  UNION ALL SELECT 'liabilities', '26_total_liabilities', {LIABILITIES}
  UNION ALL SELECT 'net_assets', '27_unrestricted', na FROM x
  UNION ALL {_zeros('net_assets', _ZERO_NET)}
  UNION ALL SELECT 'net_assets', '33_total_net_assets', na FROM x
  UNION ALL SELECT 'net_assets', '34_total_liabilities_and_net_assets', {LIABILITIES} + na FROM x)"""

_SCHEDULE = CLASSIFIED + f""",
s AS (SELECT {_exact(_sum_in(DONATIONS))} AS g, {_exact(_sum_in(["Grants"]))} AS gr,
  {_exact(_sum_in(PROGRAM))} AS p, {_exact(_sum_in(["Investment Income"]))} AS i,
  {_exact(_sum_in(["Fundraising Event Revenue"]))} AS f, {_exact(_sum_in(["Other Revenue"]))} AS o
  FROM classified),
schedule AS (SELECT *, g + gr + p + i + f + o AS total, g + gr + p + f AS pub FROM s),
rated AS (SELECT *, CASE WHEN total > 0
  THEN ROUND(CAST(pub AS DOUBLE) / CAST(total AS DOUBLE) * 100, 1) ELSE 0.0 END AS pct FROM schedule)"""

_TEXT = ("CASE WHEN {0} < 0 THEN CONCAT('($', format('{{:,.2f}}', ABS(CAST({0} AS DOUBLE))), ')') "
         "ELSE CONCAT('$', format('{{:,.2f}}', CAST({0} AS DOUBLE))) END")


def currency(column: str) -> str:
    return _TEXT.format(column)


def _displayed_worksheet() -> str:
    schedule = " UNION ALL ".join(
        f"SELECT 'schedule_a', '{section}', '{key}', '', {expr} FROM rated"
        for section, key, expr in (
            ("support", "gifts_grants_contributions", "g"), ("support", "government_grants", "gr"),
            ("support", "program_service_revenue", "p"), ("support", "investment_income", "i"),
            ("support", "fundraising_revenue", "f"), ("support", "other_revenue", "o"),
            ("support", "total_support", "total"), ("test", "public_support", "pub"),
            ("test", "public_support_percentage", "CAST(pct AS DECIMAL(28,2))"),
            ("test", "meets_33_percent_test", "CASE WHEN pct >= 33.33 THEN 1 ELSE 0 END")))
    part1_sections = (
        "CASE WHEN line_key IN ('line_1','line_2','line_3','line_4','line_12') THEN 'revenue' "
        "WHEN line_key IN ('line_13','line_15','line_18') THEN 'expenses' ELSE 'net_assets' END")
    part8_sections = (
        "CASE WHEN line_key LIKE '1e%' OR line_key LIKE '1f%' OR line_key LIKE '1h%' "
        "THEN 'contributions' WHEN line_key = '2a_total' THEN 'program' "
        "WHEN line_key = '12_total_revenue' THEN 'total' ELSE 'other' END")
    part9 = " UNION ALL ".join(
        f"SELECT 'part9', '{name}', line_key, split_part(line_key, '_', 1), {expr} FROM part9_rows "
        f"WHERE line_key = '25_total' OR (p + m + f <> 0 AND line_key IN ("
        f"'5_compensation_current_officers', '7_other_salaries', '11a_management_fees', "
        f"'13_office_expenses', '14_information_technology', '16_occupancy', '17_travel', "
        f"'19_other_expenses_a', '19_other_expenses_b', '19_other_expenses_c', '19_other_expenses_d'))"
        for name, expr in (("total", "p + m + f"), ("program_services", "p"),
                           ("management_general", "m"), ("fundraising", "f")))
    return _joined(_PART1, _PART8, _PART9, _PART10, _SCHEDULE) + f""",
shown AS (
  SELECT 'part1' AS part, {part1_sections} AS section, line_key,
    replace(line_key, 'line_', '') AS line_number, amount FROM part1_lines
    WHERE line_key NOT IN ('line_5_to_9','line_14','line_16a','line_16b','line_17','line_21')
  UNION ALL SELECT 'part8', {part8_sections}, line_key,
    CASE WHEN line_key = '2a_total' THEN '2f' ELSE split_part(line_key, '_', 1) END, amount
    FROM part8_lines WHERE line_key IN ('1e_govt_grants','1f_all_other_contributions',
      '1h_total_contributions','2a_total','3_investment_income','11_other_revenue','12_total_revenue')
      OR (line_key LIKE '8%' AND (SELECT events FROM v) > 0)
  UNION ALL SELECT 'part8', 'program', '2a_program_services', '2a', amount FROM by_label
  UNION ALL {part9}
  UNION ALL SELECT 'part10', section, line_key, split_part(line_key, '_', 1), amount FROM part10_lines
    WHERE line_key IN ('16_total_assets','26_total_liabilities','33_total_net_assets',
      '34_total_liabilities_and_net_assets')
      OR (amount <> 0 AND line_key IN ('1_cash','2_savings','3_pledges_receivable',
        '4_accounts_receivable','12_investments_other','15_other_assets','17_accounts_payable',
        '25_other_liabilities','27_unrestricted','28_temporarily_restricted',
        '29_permanently_restricted'))
  UNION ALL {schedule})
SELECT part, section, line_key, line_number, CAST(amount AS DOUBLE) AS amount,
  {currency('amount')} AS amount_text FROM shown"""


def _filtered(condition: str) -> str:
    return (f"{LEDGER} SELECT account, {DAY}, description, CAST(amount AS DOUBLE) AS amount "
            f"FROM ledger WHERE {condition}")


def _ts(text: str) -> str:
    return f"TIMESTAMP '{text} 00:00:00'"


def _between(first: str, last: str) -> str:
    return f"txn_ts >= {_ts(first)} AND txn_ts <= {_ts(last)}"


_HEADLINE = (
    "COUNT(*) AS transactions, "
    + money(f"SUM(amount) FILTER (WHERE amount > 0 AND {NOT_TRANSFER})") + " AS revenue, "
    + money(f"SUM(-amount) FILTER (WHERE amount < 0 AND {NOT_TRANSFER})") + " AS expenses, "
    + money(f"SUM(amount) FILTER (WHERE {NOT_TRANSFER})") + " AS net")

_MONTH_NAME = "strftime({0}, '%B')"
_PERIODS = LEDGER + f""",
months AS (SELECT DISTINCT date_trunc('month', txn_ts) AS m FROM ledger),
years AS (SELECT year(m) AS y, MAX(m) AS last FROM months GROUP BY year(m))
SELECT '' AS heading, 'All Dates' AS label
UNION ALL SELECT '---Months---', strftime(m, '%B %Y') FROM months
UNION ALL SELECT DISTINCT '---Quarters---', CONCAT('Q', CAST(quarter(m) AS VARCHAR), ' ',
  CAST(year(m) AS VARCHAR)) FROM months
UNION ALL SELECT '---Year to Date---', CONCAT('YTD ', CAST(y AS VARCHAR), ' (through ',
  {_MONTH_NAME.format('last')}, ')') FROM years WHERE month(last) > 1
UNION ALL SELECT '---Full Year---', CONCAT('Full Year ', CAST(y AS VARCHAR)) FROM years
UNION ALL SELECT '', 'Custom Range' FROM years GROUP BY 1"""

_ALLOCATION = CLASSIFIED + f""",
spent AS (SELECT functional, SUM(-amount) AS v FROM classified
  WHERE amount < 0 AND functional <> 'N/A' GROUP BY functional)"""

_LONG_DATE = "strftime({0}, '%B %d, %Y')"
_HEADINGS = LEDGER + f""",
r AS (SELECT account, MIN(txn_ts) AS a, MAX(txn_ts) AS b FROM ledger GROUP BY account)
SELECT account, statement, title, 'Test League' AS organization,
  CASE WHEN statement = 'position' THEN CONCAT('As of ', {_LONG_DATE.format('b')})
  ELSE CONCAT('For the Period ', {_LONG_DATE.format('a')}, ' to ', {_LONG_DATE.format('b')}) END AS period
FROM r CROSS JOIN (VALUES ('activities', 'Statement of Activities'),
  ('position', 'Statement of Financial Position'),
  ('functional_expenses', 'Statement of Functional Expenses'),
  ('cash_flows', 'Statement of Cash Flows')) t(statement, title)"""

_YEARLY = LEDGER + f""",
yearly AS (SELECT strftime(txn_ts, '%Y') AS label, MIN(txn_ts) AS a, MAX(txn_ts) AS b,
  COUNT(*) AS n, COUNT(DISTINCT account) AS accounts,
  {money("SUM(amount) FILTER (WHERE amount > 0)")} AS revenue,
  {money("SUM(-amount) FILTER (WHERE amount < 0)")} AS expenses
  FROM ledger GROUP BY strftime(txn_ts, '%Y'))"""

_OVERRIDDEN = _ACTIVITY.replace(
    "per_category AS (SELECT category, SUM(amount) AS net FROM classified GROUP BY category)",
    "edited AS (SELECT CASE WHEN source_file = 'orders' AND amount > 400000 "
    "THEN 'Supplies & Materials' ELSE category END AS category, amount FROM classified),\n"
    "per_category AS (SELECT category, SUM(amount) AS net FROM edited GROUP BY category)")

_DETAIL_DATE = "strftime(txn_ts, '%m/%d/%Y')"


def oracle_sql() -> dict[str, str]:
    classified_rows = f"account, {DAY}, description, CAST(amount AS DOUBLE) AS amount, category"
    return {
        "categorize": f"{CLASSIFIED} SELECT {classified_rows}, functional, category_type "
                      "FROM classified",
        "categorize_counts": f"{CLASSIFIED} SELECT category, functional, COUNT(*) AS n, "
                             f"{money('SUM(amount)')} AS net FROM classified "
                             "GROUP BY category, functional",
        "category_type_parent": f"{CLASSIFIED} SELECT split_part(category, ': ', 1) AS parent, "
                                "category_type, COUNT(*) AS n FROM classified GROUP BY 1, 2",
        "activities": f"{_ACTIVITY} SELECT section, ord, line_key, label, "
                      "CAST(amount AS DOUBLE) AS amount, is_total FROM activity_lines",
        "activities_totals": CLASSIFIED + f""",
per AS (SELECT account, category, SUM(amount) AS net FROM classified GROUP BY account, category),
t AS (SELECT account,
  COALESCE(SUM(ROUND(net, 2)) FILTER (WHERE category IN {in_list(dims.REVENUE_CATEGORIES)}), 0) AS tr,
  COALESCE(SUM(ROUND(ABS(net), 2)) FILTER (WHERE category IN {in_list(SPENDING)}), 0) AS te,
  COALESCE(SUM(ROUND(net, 2)) FILTER (WHERE category = {q(dims.TRANSFER)}), 0) AS nt
  FROM per GROUP BY account)
SELECT account, 'total_revenue' AS line_key, CAST(tr AS DOUBLE) AS amount FROM t
UNION ALL SELECT account, 'total_expenses', CAST(te AS DOUBLE) FROM t
UNION ALL SELECT account, 'net_transfers', CAST(nt AS DOUBLE) FROM t
UNION ALL SELECT account, 'change_in_net_assets', CAST(tr - te + nt AS DOUBLE) FROM t""",
        "financial_position": f"{_POSITION} SELECT section, label, CAST(amount AS DOUBLE) AS amount "
                              "FROM position_lines",
        "functional_expenses": f"{_FUNCTIONAL} SELECT ord, label, CAST(p AS DOUBLE) AS "
                               "program_services, CAST(m AS DOUBLE) AS management_general, "
                               "CAST(f AS DOUBLE) AS fundraising, CAST(p + m + f AS DOUBLE) AS total "
                               "FROM functional_rows",
        "cash_flows": f"{_CASH} SELECT section, ord, label, CAST(amount AS DOUBLE) AS amount "
                      "FROM cash_lines",
        "all_statements": _all_statements(),
        "period_labels": _HEADINGS,
        "filter_month": _filtered(_between("1997-01-01", "1997-01-31")),
        "filter_quarter": _filtered(_between("1996-07-01", "1996-09-30")),
        "filter_ytd": f"{LEDGER} SELECT account, {DAY}, description, CAST(amount AS DOUBLE) AS amount "
                      f"FROM ledger WHERE txn_ts >= {_ts('2001-01-01')} AND txn_ts <= "
                      "(SELECT MAX(txn_ts) FROM ledger WHERE year(txn_ts) = 2001)",
        "filter_year": _filtered("year(txn_ts) = 1998"),
        "filter_range": _filtered(f"account = 'ACCT-1' AND {_between('1996-02-10', '1996-08-20')}"),
        "filter_search": f"{CLASSIFIED} SELECT {classified_rows} FROM classified WHERE category IN "
                         "('Program Services: Travel Tournament', 'Management & General') "
                         "AND regexp_matches(description, 'ROAD|fee', 'i') "
                         "AND account IN ('ACCT-0', 'ACCT-2')",
        "filter_counts": f"{LEDGER} SELECT COUNT(*) FILTER (WHERE year(txn_ts) = 1997) AS shown, "
                         "COUNT(*) AS total FROM ledger",
        "period_options": _PERIODS,
        "kpis": f"{CLASSIFIED} SELECT {_HEADLINE} FROM classified",
        "account_summary": f"{CLASSIFIED} SELECT account, {_HEADLINE} FROM classified GROUP BY account",
        "account_counts": f"{LEDGER} SELECT account, COUNT(*) AS transactions FROM ledger "
                          "GROUP BY account",
        "revenue_by_category": f"{CLASSIFIED} SELECT category, {money('SUM(amount)')} AS amount "
                               f"FROM classified WHERE amount > 0 AND {NOT_TRANSFER} GROUP BY category",
        "expense_by_category": f"{CLASSIFIED} SELECT category, {money('SUM(-amount)')} AS amount "
                               f"FROM classified WHERE amount < 0 AND {NOT_TRANSFER} GROUP BY category",
        "monthly_cash_flow": f"{LEDGER} SELECT CAST(date_trunc('month', txn_ts) AS DATE) AS month, "
                             "strftime(date_trunc('month', txn_ts), '%b %Y') AS label, "
                             f"{money('SUM(amount) FILTER (WHERE amount > 0)')} AS revenue, "
                             f"{money('SUM(-amount) FILTER (WHERE amount < 0)')} AS expenses "
                             "FROM ledger GROUP BY date_trunc('month', txn_ts)",
        "functional_allocation": f"{_ALLOCATION} SELECT functional, {money('v')} AS amount, "
                                 "ROUND(CAST(v AS DOUBLE) / CAST((SELECT SUM(v) FROM spent) AS DOUBLE) "
                                 "* 100, 1) AS percent FROM spent",
        "program_ratio": f"{_ALLOCATION}, r AS (SELECT "
                         "CAST(SUM(v) FILTER (WHERE functional = 'Program Services') AS DOUBLE) "
                         "/ CAST(SUM(v) AS DOUBLE) * 100 AS ratio FROM spent) "
                         "SELECT ROUND(ratio, 1) AS program_percent, CASE WHEN ratio >= 75 THEN "
                         "'Excellent' WHEN ratio >= 65 THEN 'Good' ELSE 'Below recommended' END AS tier "
                         "FROM r",
        "p990_part1": f"{_PART1} SELECT line_key, CAST(amount AS DOUBLE) AS amount FROM part1_lines",
        "p990_part8": f"{_PART8} SELECT line_key, CAST(amount AS DOUBLE) AS amount FROM part8_lines",
        "p990_program_by_desc": f"{_BY_DESCRIPTION} SELECT description, CAST(amount AS DOUBLE) AS "
                                "amount FROM by_label",
        "p990_part9": f"{_PART9} SELECT ord, line_key, CAST(p + m + f AS DOUBLE) AS total, "
                      "CAST(p AS DOUBLE) AS program_services, CAST(m AS DOUBLE) AS "
                      "management_general, CAST(f AS DOUBLE) AS fundraising FROM part9_rows",
        "p990_part10": f"{_PART10} SELECT section, line_key, CAST(amount AS DOUBLE) AS amount "
                       "FROM part10_lines",
        "p990_schedule_a": f"{_SCHEDULE} SELECT CAST(g AS DOUBLE) AS gifts_grants_contributions, "
                           "CAST(gr AS DOUBLE) AS government_grants, CAST(p AS DOUBLE) AS "
                           "program_service_revenue, CAST(i AS DOUBLE) AS investment_income, "
                           "CAST(f AS DOUBLE) AS fundraising_revenue, CAST(o AS DOUBLE) AS "
                           "other_revenue, CAST(total AS DOUBLE) AS total_support, CAST(pub AS DOUBLE) "
                           "AS public_support, pct AS public_support_percentage, pct >= 33.33 AS "
                           "meets_33_percent_test FROM rated",
        "p990_receipts_tier": f"{LEDGER}, g AS (SELECT account, COALESCE(SUM(amount) FILTER "
                              "(WHERE amount > 0), 0) AS v FROM ledger GROUP BY account) "
                              f"SELECT account, {money('v')} AS gross_receipts, CASE WHEN v <= 50000 "
                              "THEN '990-N' WHEN v < 200000 THEN '990-EZ' ELSE '990' END AS form FROM g",
        "p990_header": f"{LEDGER} SELECT 'Test League' AS organization_name, '' AS ein, "
                       "strftime(MIN(txn_ts), '%m/%d/%Y') AS fiscal_year_start, "
                       "strftime(MAX(txn_ts), '%m/%d/%Y') AS fiscal_year_end, '990' AS form_type "
                       "FROM ledger",
        "displayed_worksheet": _displayed_worksheet(),
        "displayed_activities": f"{_ACTIVITY} SELECT label, CASE WHEN contains(label, ': ') THEN "
                                "split_part(label, ': ', 2) ELSE label END AS display, "
                                "contains(label, ': ') AS indented, "
                                f"{currency('amount')} AS amount_text, is_total FROM activity_lines",
        "overrides": f"{_OVERRIDDEN} SELECT section, label, CAST(amount AS DOUBLE) AS amount "
                     "FROM activity_lines",
        "archive_dedup": f"{CLASSIFIED} SELECT DISTINCT account, {DAY}, description, CAST(amount AS "
                         "DOUBLE) AS amount, CASE WHEN txn_ts > TIMESTAMP '1996-06-30 00:00:00' "
                         "AND txn_ts < TIMESTAMP '1997-01-01 00:00:00' THEN 'Supplies & Materials' "
                         "ELSE category END AS category FROM classified",
        "archive_meta": f"{_YEARLY} SELECT label, CAST(a AS DATE) AS date_range_start, "
                        "CAST(b AS DATE) AS date_range_end, CASE WHEN strftime(a, '%b %Y') = "
                        "strftime(b, '%b %Y') THEN strftime(a, '%b %Y') ELSE CONCAT(strftime(a, "
                        "'%b %Y'), ' - ', strftime(b, '%b %Y')) END AS default_label, "
                        "n AS transaction_count, accounts AS account_count, revenue AS total_revenue, "
                        "expenses AS total_expenses FROM yearly",
        "archive_top5": f"{_YEARLY} SELECT label, n AS transaction_count FROM yearly "
                        "ORDER BY b DESC, label LIMIT 5",
        "archive_range": f"{_YEARLY} SELECT strftime(MIN(a), '%Y-%m-%dT%H:%M:%S') AS "
                         "date_range_start, strftime(MAX(b), '%Y-%m-%dT%H:%M:%S') AS date_range_end "
                         "FROM yearly",
        "parse_amount": "WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS "
                        f"DECIMAL(18,2)) AS amount FROM lineitem), x AS (SELECT l_orderkey, "
                        f"l_linenumber, {amount_text_sql()} AS text FROM t) "
                        "SELECT l_orderkey, l_linenumber, text, CAST(COALESCE(TRY_CAST(replace("
                        "replace(regexp_replace(text, '[,$\\s]', '', 'g'), '(', '-'), ')', '') "
                        "AS DECIMAL(18,4)), 0) AS DOUBLE) AS parsed FROM x",
        "parse_date": "WITH x AS (SELECT o_orderkey, CASE o_orderpriority "
                      "WHEN '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d') "
                      "WHEN '2-HIGH' THEN strftime(o_orderdate, '%m/%d/%Y') "
                      "WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%b %-d, %Y') "
                      "WHEN '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%Y%m%d') "
                      "ELSE CONCAT('on ', strftime(o_orderdate, '%Y-%m-%d')) END AS text FROM orders) "
                      "SELECT o_orderkey, text, CAST(try_strptime(text, ['%Y-%m-%d', '%m/%d/%Y', "
                      "'%b %d, %Y', '%Y%m%d']) AS DATE) AS parsed FROM x",
        "transaction_detail": f"{CLASSIFIED} SELECT {_DETAIL_DATE} AS date, account, description, "
                              "CAST(amount AS DOUBLE) AS amount, category, functional, "
                              f"{currency('amount')} AS amount_text FROM classified",
        "default_accounts": "SELECT c_custkey, CONCAT('Account ', c_name, '.v1') AS account, "
                            "regexp_replace(CONCAT('AccountHistory ', c_name, '.v1.csv'), "
                            "'[^A-Za-z0-9 _-]', '_', 'g') AS safe FROM customer",
        "ingest_csv_mixed": f"{LEDGER} SELECT {DAY}, description, CAST(amount AS DOUBLE) AS amount "
                            "FROM ledger",
        "stream_accumulate": f"{CLASSIFIED}, once AS (SELECT DISTINCT account, txn_ts, description, "
                             "amount, category FROM classified) SELECT account, category, COUNT(*) AS "
                             f"n, {money('SUM(amount)')} AS net FROM once GROUP BY account, category",
    } | intake.oracle_sql(CLASSIFIED)
