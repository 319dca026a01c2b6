"""The same queries as plain SQL for DuckDB, written from their definitions."""

from __future__ import annotations

# What the published dictionary says about the panel's columns.
DESCRIPTIONS = {
    "Suplr_NPI": "Supplier NPI - NPI for the Supplier on the DMEPOS claim",
    "Suplr_Prvdr_Last_Name_Org": "Supplier Last Name/Organization Name - When registered as individual, the Supplier's last name. When registered as organization, this is the organization name",
    "Suplr_Prvdr_State_Abrvtn": "Supplier State - State postal abbreviation where the Supplier is located",
    "Suplr_Prvdr_RUCA_Desc": "Supplier RUCA Description - Description of Rural-Urban Commuting Area (RUCA) Code",
    "DME_Tot_Suplr_Benes": "Number of DME Beneficiaries - Total unique beneficiaries with DME claims (<11 are suppressed)",
    "POS_Tot_Suplr_Benes": "Number of Prosthetic/Orthotic Beneficiaries - Total unique beneficiaries",
    "Drug_Tot_Suplr_Benes": "Number of Drug/Nutritional Beneficiaries - Total unique beneficiaries",
    "DME_Tot_Suplr_Clms": "Number of DME Claims - Total DME claims submitted",
    "POS_Tot_Suplr_Clms": "Number of Prosthetic/Orthotic Claims - Total prosthetic/orthotic claims submitted",
    "Drug_Tot_Suplr_Clms": "Number of Drug/Nutritional Claims - Total drug/nutritional claims submitted",
    "DME_Suplr_Mdcr_Pymt_Amt": "DME Medicare Payment Amount - Amount Medicare paid for DME after deductible/coinsurance",
    "POS_Suplr_Mdcr_Pymt_Amt": "Prosthetic/Orthotic Medicare Payment Amount - Amount Medicare paid after deductible/coinsurance",
    "Drug_Suplr_Mdcr_Pymt_Amt": "Drug/Nutritional Medicare Payment Amount - Amount Medicare paid after deductible/coinsurance",
    "Bene_Age_LT_65_Cnt": "Number of Beneficiaries <65 - Count of beneficiaries under 65 years old",
    "Bene_Age_65_74_Cnt": "Number of Beneficiaries 65-74 - Count of beneficiaries between 65-74 years old",
    "Bene_Age_75_84_Cnt": "Number of Beneficiaries 75-84 - Count of beneficiaries between 75-84 years old",
    "Bene_Age_GT_84_Cnt": "Number of Beneficiaries >84 - Count of beneficiaries over 84 years old",
    "Bene_Feml_Cnt": "Number of Female Beneficiaries - Count of female beneficiaries",
    "Bene_Male_Cnt": "Number of Male Beneficiaries - Count of male beneficiaries",
    "Bene_Race_Wht_Cnt": "Number of White Beneficiaries - Count of non-Hispanic white beneficiaries",
    "Bene_Race_Black_Cnt": "Number of Black Beneficiaries - Count of non-Hispanic Black/African American beneficiaries",
    "Bene_Race_Api_Cnt": "Number of Asian/PI Beneficiaries - Count of Asian Pacific Islander beneficiaries",
    "Bene_Race_Hspnc_Cnt": "Number of Hispanic Beneficiaries - Count of Hispanic beneficiaries",
    "Bene_Race_Natind_Cnt": "Number of Native American/Alaska Native Beneficiaries - Count of American Indian/Alaska Native beneficiaries",
    "Bene_Race_Othr_Cnt": "Number of Other Race Beneficiaries - Count of beneficiaries with race not elsewhere classified",
    "Bene_CC_PH_Asthma_V2_Pct": "Percent with Asthma",
    "Bene_CC_PH_CKD_V2_Pct": "Percent with Chronic Kidney Disease",
    "Bene_CC_PH_COPD_V2_Pct": "Percent with Chronic Obstructive Pulmonary Disease",
    "Bene_CC_BH_Anxiety_V1_Pct": "Percent with Anxiety Disorders",
    "Bene_CC_BH_Bipolar_V1_Pct": "Percent with Bipolar Disorder",
}
FAMILIES = {
    "DME": "('MEDIUM','STANDARD')",
    "POS": "('LARGE','PROMO')",
    "Drug": "('SMALL','ECONOMY')",
}
RACES = {
    "Wht": "MEDIUM",
    "Black": "STANDARD",
    "Api": "LARGE",
    "Hspnc": "PROMO",
    "Natind": "SMALL",
    "Othr": "ECONOMY",
}
AGES = {
    "LT_65": "c_acctbal < 1700",
    "65_74": "c_acctbal >= 1700 AND c_acctbal < 4300",
    "75_84": "c_acctbal >= 4300 AND c_acctbal < 7350",
    "GT_84": "c_acctbal >= 7350",
}
GENDERS = {"Feml": "F", "Male": "O"}
CONDITIONS = {
    "PH_Asthma_V2": "o_orderpriority = '1-URGENT'",
    "PH_CKD_V2": "o_orderpriority = '2-HIGH'",
    "PH_COPD_V2": "o_orderpriority = '3-MEDIUM'",
    "BH_Anxiety_V1": "l_returnflag = 'R'",
    "BH_Bipolar_V1": "l_returnflag = 'A'",
}
AGE_COLUMNS = [f"Bene_Age_{a}_Cnt" for a in AGES]
GENDER_COLUMNS = [f"Bene_{g}_Cnt" for g in GENDERS]
RACE_COLUMNS = [f"Bene_Race_{r}_Cnt" for r in RACES]
SHARE_GROUPS = {
    "Age Distribution": AGE_COLUMNS,
    "Gender Distribution": GENDER_COLUMNS,
    "Race Distribution": RACE_COLUMNS,
}
CONDITION_COLUMNS = [f"Bene_CC_{c}_Pct" for c in CONDITIONS]
CONDITION_GROUPS = {
    "Physical Health Conditions": [c for c in CONDITION_COLUMNS if "_PH_" in c],
    "Behavioral Health Conditions": [c for c in CONDITION_COLUMNS if "_BH_" in c],
}
BENES = [f"{f}_Tot_Suplr_Benes" for f in FAMILIES]
CLAIMS = [f"{f}_Tot_Suplr_Clms" for f in FAMILIES]
PAID = [f"{f}_Suplr_Mdcr_Pymt_Amt" for f in FAMILIES]
ALL_COLUMNS = [
    "Suplr_NPI",
    "year",
    "Suplr_Prvdr_Last_Name_Org",
    "Suplr_Prvdr_State_Abrvtn",
    "Suplr_Prvdr_RUCA_Desc",
    *BENES,
    *CLAIMS,
    *PAID,
    *AGE_COLUMNS,
    *GENDER_COLUMNS,
    *RACE_COLUMNS,
    *CONDITION_COLUMNS,
]


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _panel() -> str:
    pay = "l_extendedprice::DECIMAL(18,2) * (1::DECIMAL(4,2) - l_discount::DECIMAL(4,2))"
    items = [
        'l_suppkey AS "Suplr_NPI"',
        "CAST(year(l_shipdate) AS INTEGER) AS year",
        "min(s_name) AS Suplr_Prvdr_Last_Name_Org",
        "min(n_name) AS Suplr_Prvdr_State_Abrvtn",
        "min(r_name) AS Suplr_Prvdr_RUCA_Desc",
    ]
    for family, types in FAMILIES.items():
        benes = f"count(DISTINCT CASE WHEN p_type IN {types} THEN o_custkey END)"
        items += [
            f"CASE WHEN l_suppkey % 7 <> 3 THEN {benes} END AS {family}_Tot_Suplr_Benes",
            f"count(DISTINCT CASE WHEN p_type IN {types} THEN l_orderkey END)"
            f" AS {family}_Tot_Suplr_Clms",
            f"sum(CASE WHEN p_type IN {types} THEN {pay} END) AS {family}_Suplr_Mdcr_Pymt_Amt",
        ]
    tests = {f"Bene_Age_{a}_Cnt": test for a, test in AGES.items()}
    tests |= {f"Bene_{g}_Cnt": f"l_linestatus = '{s}'" for g, s in GENDERS.items()}
    tests |= {f"Bene_Race_{r}_Cnt": f"p_type = '{t}'" for r, t in RACES.items()}
    items += [
        f"count(DISTINCT CASE WHEN {test} THEN o_custkey END) AS {name}"
        for name, test in tests.items()
    ]
    for name, test in CONDITIONS.items():
        hits = f"sum(CASE WHEN {test} THEN 1 ELSE 0 END)"
        value = (
            f"cast(cast(floor(cast(10000 as double)*{hits}/count(*)) as bigint) as decimal(9,2))"
            "*cast(0.01 as decimal(3,2))"
        )
        items.append(
            f"CASE WHEN (l_suppkey + year(l_shipdate)) % 5 <> 0 THEN {value} END AS Bene_CC_{name}_Pct"
        )
    return (
        "panel AS (SELECT " + ",\n ".join(items) + "\nFROM lineitem"
        " LEFT JOIN orders ON l_orderkey = o_orderkey"
        " LEFT JOIN customer ON o_custkey = c_custkey"
        " LEFT JOIN part ON l_partkey = p_partkey"
        " LEFT JOIN supplier ON l_suppkey = s_suppkey"
        " LEFT JOIN nation ON s_nationkey = n_nationkey"
        " LEFT JOIN region ON n_regionkey = r_regionkey"
        " GROUP BY l_suppkey, year(l_shipdate))"
    )


PANEL = _panel()


def with_panel(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([PANEL, *ctes]) + "\n" + body


def total(name: str) -> str:
    kind = "DOUBLE" if name in PAID else "BIGINT"
    return f"CAST(coalesce(sum({name}),0) AS {kind})"


OVERVIEW = f"""overview AS (SELECT year AS "Year", count(*) AS "Suppliers",
 {total(BENES[0])} AS "Total Beneficiaries", {total(CLAIMS[0])} AS "Total Claims",
 {total(PAID[0])} AS "Total Payments ($)" FROM panel GROUP BY year)"""

SPENDING = f"""spending AS (SELECT year AS "Year", {total(BENES[0])} AS "Total Beneficiaries",
 {total(PAID[0])} AS "Total Spending",
 CASE WHEN {total(BENES[0])} > 0 THEN {total(PAID[0])} / {total(BENES[0])} ELSE 0.0::DOUBLE END
   AS "Spending Per Beneficiary",
 {total(PAID[0])} AS "DME Spending", {total(PAID[1])} AS "Prosthetic/Orthotic Spending",
 {total(PAID[2])} AS "Drug Spending" FROM panel GROUP BY year)"""


def label(name: str) -> str:
    return quoted(DESCRIPTIONS[name].split(" - ")[0])


def _shares() -> str:
    branches = []
    ordinal = 0
    for group, names in SHARE_GROUPS.items():
        whole = " + ".join(total(n) for n in names)
        for name in names:
            ordinal += 1
            branches.append(
                f"SELECT year, {quoted(group)} AS \"group\", CAST({ordinal} AS INTEGER) AS ordinal,"
                f" {label(name)} AS label,"
                f" round_even({total(name)}::DOUBLE / nullif({whole},0)::DOUBLE * 100.0 * 100.0, 0)"
                " / 100.0 AS pct FROM panel GROUP BY year"
            )
    return "shares AS (" + "\nUNION ALL ".join(branches) + ")"


def _means() -> str:
    branches = []
    ordinal = 0
    for group, names in CONDITION_GROUPS.items():
        for name in names:
            ordinal += 1
            branches.append(
                f"SELECT year, {quoted(group)} AS \"group\", CAST({ordinal} AS INTEGER) AS ordinal,"
                f" {label(name)} AS label, CAST(coalesce(sum({name}*{BENES[0]}),0) AS DOUBLE)"
                f" / CAST(nullif(sum({BENES[0]}),0) AS DOUBLE) AS value FROM panel GROUP BY year"
            )
    return "means AS (" + "\nUNION ALL ".join(branches) + ")"


SHARES = _shares()
MEANS = _means()
MEAN_RANKS = """mean_ranks AS (SELECT *, CAST(row_number() OVER (PARTITION BY year, "group"
 ORDER BY value DESC NULLS LAST, ordinal) AS INTEGER) AS rank FROM means)"""
ONE_YEAR = "one_year AS (SELECT * FROM panel WHERE year = 2000)"
BEST = f"""best AS (SELECT "Suplr_NPI" AS key, Suplr_Prvdr_Last_Name_Org AS "Supplier",
 {BENES[0]} AS "Beneficiaries", {CLAIMS[0]} AS "Claims",
 CAST({PAID[0]} AS DOUBLE) AS payments FROM one_year
 ORDER BY {BENES[0]} DESC NULLS LAST, "Suplr_NPI" LIMIT 10)"""
CURRENCY = "concat('$', format('{{:,.2f}}', {0}))"
CHANGES = [
    ("Suppliers", "Suppliers"),
    ("Beneficiaries", "Total Beneficiaries"),
    ("Claims", "Total Claims"),
    ("Payments", "Total Payments ($)"),
]


def currency(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN concat('$', format('{{:,.2f}}', {c})) END"


def _two_years() -> str:
    def at(c: str, y: int) -> str:
        return f'max(CASE WHEN "Year" = {y} THEN "{c}" END)::DOUBLE'

    return "changes AS (" + "\nUNION ALL ".join(
        f"SELECT '{metric}' AS \"Metric\", ({at(c, 2000)} - {at(c, 1999)})"
        f' / nullif({at(c, 1999)}, 0) * 100.0 AS "Change 1999-2000 (%)" FROM overview'
        ' HAVING count(DISTINCT CASE WHEN "Year" IN (1999, 2000) THEN "Year" END) = 2'
        for metric, c in CHANGES
    ) + ")"


TWO_YEARS = _two_years()
SERIES = ["DME Spending", "Prosthetic/Orthotic Spending", "Drug Spending"]
YOY = [
    ("Beneficiaries", "Total Beneficiaries"),
    ("Spending", "Total Spending"),
    ("Per Beneficiary", "Spending Per Beneficiary"),
]


def _yoy() -> str:
    return with_panel(
        "\nUNION ALL ".join(
            f"SELECT \"Year\", '{metric}' AS \"Metric\", (\"{c}\"::DOUBLE / nullif(before,0) - 1.0)"
            ' * 100.0 AS "Percentage Change (%)" FROM (SELECT *, row_number() OVER (ORDER BY "Year")'
            f' AS place, lag("{c}"::DOUBLE) OVER (ORDER BY "Year") AS before FROM spending)'
            " WHERE place > 1"
            for metric, c in YOY
        ),
        SPENDING,
    )


def _pct_change() -> str:
    filled = ",".join(
        f"last_value({c}::DOUBLE IGNORE NULLS) OVER (PARTITION BY \"Suplr_NPI\" ORDER BY year"
        f" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {alias}"
        for c, alias in ((BENES[0], "b"), (PAID[0], "p"))
    )
    w = 'OVER (PARTITION BY "Suplr_NPI" ORDER BY year)'
    return with_panel(
        f"""SELECT "Suplr_NPI", year, (b / nullif(lag(b) {w}, 0) - 1.0) * 100.0 AS benes_change,
 (p / nullif(lag(p) {w}, 0) - 1.0) * 100.0 AS paid_change FROM filled""",
        f'filled AS (SELECT "Suplr_NPI", year, {filled} FROM panel)',
    )


SPENDING_TEXT = (
    "SELECT format('{:,}', \"Year\") AS \"Year\","
    ' format(\'{:,}\', "Total Beneficiaries") AS "Total Beneficiaries", '
    + ", ".join(
        f"""{currency('"' + c + '"')} AS "{c}\""""
        for c in ("Total Spending", "Spending Per Beneficiary", *SERIES)
    )
    + " FROM spending"
)
OVERVIEW_TEXT = """SELECT "Year", "Suppliers",
 format('{:,}', "Total Beneficiaries") AS "Total Beneficiaries",
 format('{:,}', "Total Claims") AS "Total Claims",
 format('{:,.0f}', "Total Payments ($)") AS "Total Payments ($)" FROM overview"""

CATEGORY_CASE = """CASE WHEN starts_with({0}, 'Suplr_') THEN 'Supplier Information'
 WHEN starts_with({0}, 'DME_') THEN 'Durable Medical Equipment'
 WHEN starts_with({0}, 'POS_') THEN 'Prosthetics and Orthotics'
 WHEN starts_with({0}, 'Drug_') THEN 'Drug and Nutritional Products'
 WHEN starts_with({0}, 'Bene_CC_BH_') THEN 'Beneficiary Behavioral Health Conditions'
 WHEN starts_with({0}, 'Bene_CC_PH_') THEN 'Beneficiary Physical Health Conditions'
 WHEN starts_with({0}, 'Bene_') THEN 'Beneficiary Demographics' ELSE 'Other' END"""

DICTIONARY = "dictionary AS (SELECT * FROM (VALUES " + ", ".join(
    f"({quoted(name)}, {quoted(text)})" for name, text in DESCRIPTIONS.items()
) + ') t("column", description))'


def _observed(names: list[str]) -> str:
    return "observed AS (" + " UNION ALL ".join(
        f"SELECT {i} AS ordinal, {quoted(c)} AS \"column\", count(\"{c}\") AS filled FROM panel"
        for i, c in enumerate(names, 1)
    ) + ")"


def _categories(names: list[str]) -> list[str]:
    category = CATEGORY_CASE.format('"column"')
    return [
        _observed(names),
        DICTIONARY,
        f"""ranked AS (SELECT *, {category} AS category, row_number() OVER (
 PARTITION BY {category} ORDER BY ordinal) AS rank FROM observed WHERE filled > 0)""",
        """category_rows AS (SELECT category, count(*) AS columns,
 string_agg("column", ', ' ORDER BY rank) FILTER (WHERE rank <= 3) AS examples,
 string_agg(coalesce(description, '-'), ' | ' ORDER BY rank) FILTER (WHERE rank <= 3)
   AS descriptions FROM ranked LEFT JOIN dictionary USING ("column") GROUP BY category)""",
    ]


def _dictionary_join() -> str:
    names = [*BENES, *CLAIMS, *AGE_COLUMNS, *GENDER_COLUMNS, *RACE_COLUMNS]
    branches = " UNION ALL ".join(
        f"SELECT year, Suplr_Prvdr_State_Abrvtn, '{n}' AS \"column\", {total(n)} AS value"
        " FROM panel GROUP BY year, Suplr_Prvdr_State_Abrvtn"
        for n in names
    )
    return with_panel(
        'SELECT long.*, split_part(description, \' - \', 1) AS label, description'
        ' FROM long JOIN dictionary USING ("column")',
        DICTIONARY,
        f"long AS ({branches})",
    )


LINE_COLUMNS = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax"
    " l_returnflag l_linestatus l_shipdate"
).split()


def _line_columns() -> str:
    """The columns of the order lines that have a value, by prefix."""
    observed = " UNION ALL ".join(
        f"SELECT {i} AS ordinal, '{c}' AS name, count({c}) AS filled FROM lineitem"
        for i, c in enumerate(LINE_COLUMNS, 1)
    )
    return f"""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ordinal)
 AS rank FROM (SELECT *, CASE WHEN starts_with(name, 'l_line') THEN 'Line'
 WHEN starts_with(name, 'l_ship') THEN 'Shipping' WHEN starts_with(name, 'l_') THEN 'Rest'
 ELSE 'Other' END AS category FROM ({observed})) WHERE filled > 0)
 SELECT category, count(*) AS columns,
 string_agg(name, ', ' ORDER BY rank) FILTER (WHERE rank <= 3) AS examples,
 string_agg('-', ' | ' ORDER BY rank) FILTER (WHERE rank <= 3) AS descriptions
 FROM ranked GROUP BY category"""


LATEST = "(SELECT max(year) FROM panel)"


def _report() -> str:
    report_columns = [c for c in ALL_COLUMNS if c != "year"]
    spending_columns = ["Total Beneficiaries", "Total Spending", "Spending Per Beneficiary", *SERIES]
    overview_columns = ["Suppliers", "Total Beneficiaries", "Total Claims", "Total Payments ($)"]
    branches: list[str] = []

    def add(number: int, section: str, order: str, rows: list[tuple[str, str, str, str]], source: str):
        """A branch for each place in an item: item, metric, text and a condition."""
        for place, (item, metric, text, where) in enumerate(rows):
            branches.append(
                f"SELECT {number} AS section_no, '{section}' AS section, {order} AS o,"
                f" {place} AS place, CAST({item} AS VARCHAR) AS item, {metric} AS metric,"
                f" CAST({text} AS VARCHAR) AS text FROM {source} WHERE {where}"
            )

    def cells(item: str, columns: list[str]) -> list[tuple[str, str, str, str]]:
        return [(item, quoted(c), f'"{c}"', "true") for c in columns]

    add(1, "Overview", '"Year"', cells('"Year"', overview_columns), "overview_text")
    place = " ".join(f"WHEN '{m}' THEN {i}" for i, (m, _) in enumerate(CHANGES))
    change = "'Change 1999-2000 (%)'"
    text = "format('{:.2f}%', \"Change 1999-2000 (%)\")"
    add(2, "Change", f'CASE "Metric" {place} END', [(change, '"Metric"', text, "true")], "changes")
    by_category = "dense_rank() OVER (ORDER BY category)"
    add(3, "Column categories", by_category, cells("category", ["columns", "examples"]), "category_rows")
    for rank in (1, 2, 3):
        branches.append(
            f"SELECT 3, 'Column categories', (SELECT count(DISTINCT category) FROM ranked b"
            f" WHERE b.category <= a.category), {rank + 1}, category, \"column\", description"
            f" FROM ranked a JOIN dictionary USING (\"column\") WHERE rank = {rank}"
        )
    best = 'row_number() OVER (ORDER BY "Beneficiaries" DESC NULLS LAST, "Supplier")'
    add(4, "Top suppliers", best, cells('"Supplier"', ["Beneficiaries", "Claims", "Medicare Payments"]), "best_text")
    shown = [('"group"', "label", "format('{:.2f}%', pct)", f"year = {LATEST}")]
    add(5, "Demographics", "ordinal", shown, "shares")
    shown = [('"group"', "label", "format('{:.2f}%', value)", f"year = {LATEST} AND rank <= 10")]
    first = "CASE WHEN \"group\" LIKE 'Physical%' THEN 0 ELSE 1000 END + rank"
    add(6, "Health conditions", first, shown, "mean_ranks")
    by_year = 'dense_rank() OVER (ORDER BY "Year")'
    add(7, "Spending", by_year, cells('"Year"', spending_columns), "spending_text")
    category_ctes = _categories(report_columns)
    category_ctes[2] = category_ctes[2].replace("WHERE filled > 0", "")
    return with_panel(
        "SELECT CAST(section_no AS INTEGER) AS section_no, CAST(row_number() OVER (PARTITION BY"
        " section_no ORDER BY o, place) AS INTEGER) AS line, section, item, metric, text FROM ("
        + "\nUNION ALL ".join(branches)
        + ")",
        OVERVIEW,
        f"overview_text AS ({OVERVIEW_TEXT})",
        TWO_YEARS,
        *category_ctes,
        f"one_year AS (SELECT * FROM panel WHERE year = {LATEST})",
        BEST,
        f'best_text AS (SELECT *, {currency("payments")} AS "Medicare Payments" FROM best)',
        SHARES,
        MEANS,
        MEAN_RANKS,
        SPENDING,
        f"spending_text AS ({SPENDING_TEXT})",
    )


def _charts() -> str:
    """Every chart as text lines."""
    branches: list[str] = []

    def add(chart: str, order: str, columns: dict[str, bool], source: str) -> None:
        """Columns, and whether they are shown with four places."""
        for c, places in columns.items():
            text = f"format('{{:,.4f}}', \"{c}\")" if places else f'CAST("{c}" AS VARCHAR)'
            shown = f'CASE WHEN "{c}" IS NOT NULL THEN {text} END'
            branches.append(
                f"SELECT '{chart}' AS chart, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER)"
                f" AS line, '{c}' AS \"column\", {shown} AS text FROM {source}"
            )

    trends = {"Year": False, "Total Beneficiaries": False, "Total Spending": True}
    trends |= {"Spending Per Beneficiary": True} | dict.fromkeys(SERIES, True)
    add("spending_trends", '"Year"', trends, "spending")
    billions = {"Year": False, "Category": False, "Spending (Billions $)": True}
    add("spending_by_category", '"Year", "Category"', billions, "by_category")
    pie = {"group": False, "position": False, "label": False, "pct": True, "slice": False}
    add("demographics", '"group", position', pie, "pies")
    means = {"group": False, "rank": False, "label": False, "value": True}
    add("health_conditions", '"group", rank', means, "best_means")
    suppliers = {"Supplier": False, "Beneficiaries": False, "Claims": False, "Medicare Payments": False}
    suppliers |= {"Medicare Payments (Numeric)": True, "payments_place": False, "beneficiaries_place": False}
    add("top_suppliers", "payments_place", suppliers, "places")
    add("top_states", '"Suppliers" DESC, "State"', {"State": False, "Suppliers": False}, "states")
    regions = {"RUCA Description": False, "Suppliers": False, "share": True, "slice": False}
    add("ruca_share", '"Suppliers" DESC, "RUCA Description"', regions, "regions")
    by_category = " UNION ALL ".join(
        f"SELECT \"Year\", '{c}' AS \"Category\", \"{c}\" / 1e9 AS \"Spending (Billions $)\" FROM spending"
        for c in SERIES
    )
    return with_panel(
        "\nUNION ALL ".join(branches),
        SPENDING,
        SHARES,
        MEANS,
        MEAN_RANKS,
        f"one_year AS (SELECT * FROM panel WHERE year = {LATEST})",
        BEST,
        PRICED,
        f"by_category AS ({by_category})",
        f"pies AS (SELECT * FROM ({PIES}) WHERE year = {LATEST})",
        f"best_means AS (SELECT * FROM mean_ranks WHERE rank <= 10 AND year = {LATEST})",
        f"places AS ({PLACES})",
        f"states AS ({STATES})",
        f"regions AS ({REGIONS})",
    )


PRICED = f"""priced AS (SELECT *, {currency("payments")} AS "Medicare Payments",
 CAST(replace(replace({currency("payments")}, '$', ''), ',', '') AS DOUBLE) AS cents FROM best)"""
PLACES = """SELECT "Supplier", "Beneficiaries", "Claims", "Medicare Payments", cents
 AS "Medicare Payments (Numeric)",
 CAST(row_number() OVER (ORDER BY cents NULLS LAST, key) AS INTEGER) AS payments_place,
 CAST(row_number() OVER (ORDER BY "Beneficiaries" NULLS LAST, key) AS INTEGER)
   AS beneficiaries_place FROM priced"""
PIES = """SELECT year, "group", CAST(row_number() OVER (PARTITION BY year, "group" ORDER BY
 CASE WHEN "group" = 'Race Distribution' THEN pct END DESC NULLS LAST, ordinal) AS INTEGER)
 AS position, label, pct, format('{:.1f}%', pct / nullif(sum(pct::DECIMAL(9,2)) OVER (
 PARTITION BY year, "group")::DOUBLE, 0) * 100.0) AS slice FROM shares"""
STATES = """SELECT Suplr_Prvdr_State_Abrvtn AS "State", count(*) AS "Suppliers" FROM one_year
 WHERE Suplr_Prvdr_State_Abrvtn IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"""
REGIONS = """SELECT name AS "RUCA Description", n AS "Suppliers",
 n::DOUBLE / (sum(n) OVER ())::DOUBLE * 100.0 AS share,
 format('{:.1f}%', n::DOUBLE / (sum(n) OVER ())::DOUBLE * 100.0) AS slice
 FROM (SELECT Suplr_Prvdr_RUCA_Desc AS name, count(*) AS n FROM one_year
 WHERE Suplr_Prvdr_RUCA_Desc IS NOT NULL GROUP BY 1)"""

PRIORITY_CASE = """CASE WHEN starts_with(o_orderpriority, '1-') THEN 'Pressing'
 WHEN starts_with(o_orderpriority, '2-') THEN 'Pressing'
 WHEN starts_with(o_orderpriority, '3-M') THEN 'Normal'
 WHEN starts_with(o_orderpriority, '3') THEN 'Never' ELSE 'Other' END"""

PLAIN = "format('{:.2f}', l_extendedprice)"

LOADED = ", ".join(
    f'CAST("{c}" AS VARCHAR) AS "{c}"'
    if c == "Suplr_NPI"
    else f'CAST("{c}" AS DOUBLE) AS "{c}"'
    if c in PAID or c in CONDITION_COLUMNS
    else f'"{c}"'
    for c in ALL_COLUMNS
)
SPENDING_ROWS = f"""SELECT "Suplr_NPI", year, {BENES[0]}, {", ".join(
    f"CAST({c} AS DOUBLE) AS {c}" for c in PAID)} FROM panel"""

MISSING = " UNION ALL ".join(
    f"SELECT year, '{c}' AS \"column\", count(*) - count(\"{c}\") AS missing,"
    f" round_even((count(*) - count(\"{c}\"))::DOUBLE / count(*)::DOUBLE * 100.0 * 100.0, 0) / 100.0"
    " AS percent FROM panel GROUP BY year"
    for c in ALL_COLUMNS
    if c != "year"
)
MEASURED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DESCRIBE = " UNION ALL ".join(
    f"SELECT l_returnflag, '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean,"
    f" round(stddev_samp({c}), 4) AS std, min({c}) AS min, max({c}) AS max,"
    f" quantile_disc({c}, 0.25) AS q1, quantile_disc({c}, 0.5) AS median,"
    f" quantile_disc({c}, 0.75) AS q3 FROM lineitem GROUP BY 1"
    for c in MEASURED
)
CORRELATION = " UNION ALL ".join(
    f"SELECT l_linestatus, '{a}' AS first, '{b}' AS second, round(corr({a}, {b}), 6) AS correlation"
    " FROM lineitem GROUP BY 1"
    for i, a in enumerate(MEASURED)
    for b in MEASURED[i + 1 :]
)
WIDE = [*BENES, *CLAIMS, *PAID, *AGE_COLUMNS, *GENDER_COLUMNS, *RACE_COLUMNS, *CONDITION_COLUMNS]
PANEL_CORRELATION = with_panel(
    "SELECT year, cell.first AS first, cell.second AS second,"
    " CASE WHEN NOT isnan(cell.correlation) THEN round(cell.correlation, 6) + 0.0 END AS correlation"
    " FROM (SELECT year, unnest(["
    + ", ".join(
        f"{{'first': '{a}', 'second': '{b}', 'correlation': corr({a}, {b})}}"
        for i, a in enumerate(WIDE)
        for b in WIDE[i + 1 :]
    )
    + "]) AS cell FROM panel GROUP BY year)"
)

ORACLE: dict[str, str] = {
    "yearly_overview": with_panel("SELECT * FROM overview", OVERVIEW),
    "overview_report": with_panel(OVERVIEW_TEXT, OVERVIEW),
    "column_sums": with_panel(
        "SELECT year, "
        + ", ".join(f"{total(n)} AS {n}" for n in (*BENES, *CLAIMS, *PAID))
        + " FROM panel GROUP BY year"
    ),
    "spending_patterns": with_panel("SELECT * FROM spending", SPENDING),
    "spending_report": with_panel(SPENDING_TEXT, SPENDING),
    "spending_by_category": with_panel(
        "\nUNION ALL ".join(
            f"SELECT \"Year\", '{c}' AS \"Category\", \"{c}\" / 1e9 AS \"Spending (Billions $)\""
            " FROM spending"
            for c in SERIES
        ),
        SPENDING,
    ),
    "pct_change": _pct_change(),
    "yoy_series": _yoy(),
    "two_year_change": with_panel("SELECT * FROM changes", OVERVIEW, TWO_YEARS),
    "change_report": with_panel(
        "SELECT \"Metric\", format('{:.2f}%', \"Change 1999-2000 (%)\")"
        ' AS "Change 1999-2000 (%)" FROM changes',
        OVERVIEW,
        TWO_YEARS,
    ),
    "demographic_shares": with_panel("SELECT * FROM shares", SHARES),
    "demographics_report": with_panel(
        "SELECT \"group\", label, format('{:.2f}%', pct) AS pct FROM shares WHERE year = 2000",
        SHARES,
    ),
    "demographic_chart": with_panel(PIES, SHARES),
    "weighted_prevalence": with_panel("SELECT * FROM means", MEANS),
    "top_conditions": with_panel(
        'SELECT year, "group", rank, label, value FROM mean_ranks WHERE rank <= 2',
        MEANS,
        MEAN_RANKS,
    ),
    "conditions_report": with_panel(
        "SELECT \"group\", rank, label, format('{:.2f}%', value) AS value FROM mean_ranks"
        " WHERE rank <= 10 AND year = 2000",
        MEANS,
        MEAN_RANKS,
    ),
    "top_suppliers": with_panel(
        f'SELECT "Supplier", "Beneficiaries", "Claims", {currency("payments")}'
        ' AS "Medicare Payments" FROM best',
        ONE_YEAR,
        BEST,
    ),
    "top_suppliers_chart": with_panel(PLACES, ONE_YEAR, BEST, PRICED),
    "top_states": with_panel(STATES, ONE_YEAR),
    "value_counts": with_panel(
        """SELECT year, Suplr_Prvdr_State_Abrvtn AS "State", count(*) AS "Suppliers" FROM panel
 WHERE Suplr_Prvdr_State_Abrvtn IS NOT NULL GROUP BY 1, 2"""
    ),
    "ruca_share": with_panel(REGIONS, ONE_YEAR),
    "year_filter": with_panel(SPENDING_ROWS + " WHERE year = 2000"),
    "latest_year": with_panel(SPENDING_ROWS + " WHERE year = (SELECT max(year) FROM panel)"),
    "shape": with_panel(
        f"SELECT year, count(*) AS rows, CAST({len(ALL_COLUMNS)} AS INTEGER) AS columns"
        " FROM panel GROUP BY year"
    ),
    "prefix_category": f"""SELECT {PRIORITY_CASE} AS category, o_orderpriority,
 count(*) AS orders FROM orders GROUP BY 1, 2""",
    "category_overview": _line_columns(),
    "name_categories": """WITH names AS (SELECT p_partkey AS ordinal,
 concat_ws('_', p_type, p_name, CAST(p_partkey AS VARCHAR)) AS name FROM part),
 tagged AS (SELECT *, CASE WHEN starts_with(name, 'SMALL_red') THEN 'Small red'
 WHEN starts_with(name, 'SMALL') THEN 'Small' WHEN starts_with(name, 'LARGE') THEN 'Large'
 ELSE 'Other' END AS category FROM names),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ordinal, name) AS rank
 FROM tagged)
 SELECT category, count(*) AS columns,
 string_agg(name, ', ' ORDER BY rank) FILTER (WHERE rank <= 3) AS examples
 FROM ranked GROUP BY category""",
    "dictionary_join": _dictionary_join(),
    "label_split": """SELECT split_part(concat_ws(' - ', o_orderpriority, o_orderstatus,
 CAST(o_orderkey AS VARCHAR)), ' - ', 1) AS label, count(*) AS orders FROM orders GROUP BY 1""",
    "format_currency": f"SELECT o_orderkey, {currency('o_totalprice')} AS text FROM orders",
    "format_count": "SELECT o_orderkey, format('{:,.0f}', o_totalprice) AS text FROM orders",
    "format_percent": """WITH sums AS (SELECT l_suppkey,
 CAST(sum(l_extendedprice::DECIMAL(18,2) * l_discount::DECIMAL(4,2)) AS DOUBLE) AS reduced,
 CAST(sum(l_extendedprice::DECIMAL(18,2)) AS DOUBLE) AS full_price FROM lineitem GROUP BY 1)
 SELECT l_suppkey, round_even(reduced / full_price * 100.0 * 100.0, 0) / 100.0 AS rate,
 format('{:.2f}%', reduced / full_price * 100.0) AS two_places,
 format('{:.1f}%', reduced / full_price * 100.0) AS one_place FROM sums""",
    "format_scaled": with_panel(
        f"""SELECT "Suplr_NPI", right(CAST(year AS VARCHAR), 2) AS yy,
 concat('$', format('{{:.1f}}', paid / 1e9), 'B') AS billions,
 concat('$', format('{{:.1f}}', paid / 1e6), 'M') AS millions,
 concat('$', format('{{:.0f}}', paid)) AS dollars, format('{{:.0f}}', paid) AS plain
 FROM (SELECT "Suplr_NPI", year, CAST({PAID[0]} AS DOUBLE) AS paid FROM panel)
 WHERE paid IS NOT NULL UNION ALL SELECT "Suplr_NPI", right(CAST(year AS VARCHAR), 2),
 NULL, NULL, NULL, NULL FROM panel WHERE {PAID[0]} IS NULL"""
    ),
    "parse_currency": """SELECT o_orderkey,
 CAST(replace(format('{:.2f}', o_totalprice), ',', '') AS DOUBLE) AS amount FROM orders""",
    "coerce_money": f"""SELECT l_suppkey, l_linenumber, count(amount) AS numbers,
 count(*) AS texts, CAST(coalesce(sum(amount::DECIMAL(18,2)), 0) AS DOUBLE) AS amount FROM (
 SELECT l_suppkey, l_linenumber, CASE WHEN l_linenumber IN (1, 2, 4, 6) THEN NULL
 WHEN l_linenumber = 5 THEN CAST({PLAIN} || 'e1' AS DOUBLE) ELSE CAST({PLAIN} AS DOUBLE) END
 AS amount FROM lineitem) GROUP BY 1, 2""",
    "csv_scan": """SELECT printf('%09d', l_suppkey) AS zip, l_orderkey, l_linenumber,
 CASE WHEN l_linenumber IN (1, 2) THEN NULL WHEN l_linenumber = 3
 THEN concat(l_returnflag, ', "x"') ELSE l_returnflag END AS mark,
 format('{:,.2f}', l_extendedprice) AS price FROM lineitem""",
    "panel_load": with_panel(f"SELECT {LOADED} FROM panel"),
    "panel_union": with_panel(
        f"""SELECT "Suplr_NPI", year, Suplr_Prvdr_Last_Name_Org, {BENES[0]},
 CASE WHEN year % 3 <> 0 THEN {CLAIMS[0]} END AS {CLAIMS[0]},
 CAST({PAID[0]} AS DOUBLE) AS {PAID[0]},
 CASE WHEN year = (SELECT max(year) FROM panel) THEN {BENES[0]} + 1 END AS "Extra" FROM panel"""
    ),
    "panel_refresh": with_panel(
        f"""SELECT CAST("Suplr_NPI" AS VARCHAR) AS "Suplr_NPI", year, Suplr_Prvdr_Last_Name_Org, {BENES[0]},
 {CLAIMS[0]} + CASE WHEN year = (SELECT max(year) FROM panel) THEN 1 ELSE 0 END AS {CLAIMS[0]},
 CAST({PAID[0]} AS DOUBLE) AS {PAID[0]}, year = (SELECT max(year) FROM panel) AS rewritten
 FROM panel WHERE year > (SELECT min(year) FROM panel)"""
    ),
    "panel_quarantine": with_panel(
        f"""SELECT year, CASE WHEN "Suplr_NPI" % 10 = 3 THEN 'more fields than the header' ELSE 'kept' END AS outcome,
 count(*) AS records, CAST(sum({CLAIMS[0]}) AS BIGINT) AS claims FROM panel GROUP BY 1, 2"""
    ),
    "save_results": with_panel("SELECT * FROM spending", SPENDING),
    "json_scan": """SELECT CAST(o_orderkey AS VARCHAR) AS "Order_NPI", o_custkey AS "Order_Cnt",
 o_totalprice AS "Order_Pymt", nullif(o_orderstatus, 'P') AS mark FROM orders""",
    "json_drift": """SELECT CASE WHEN o_orderkey % 4 IN (0, 1) THEN o_custkey END AS "Order_Cnt",
 CAST(o_orderkey AS VARCHAR) AS "Order_NPI",
 CASE WHEN o_orderkey % 4 IN (0, 2) THEN o_totalprice END AS "Order_Pymt",
 CASE WHEN o_orderkey % 4 = 1 THEN o_orderstatus END AS mark,
 CASE WHEN o_orderkey % 4 = 2 THEN '{"priority":"' || o_orderpriority || '"}' END AS note
 FROM orders WHERE o_orderkey % 28 <> 3""",
    "json_field_kinds": """WITH kinds(shape, field, kind) AS (VALUES (0, 'Order_NPI', 'number'),
 (0, 'Order_Cnt', 'number'), (0, 'Order_Pymt', 'number'), (1, 'Order_NPI', 'text'), (1, 'Order_Cnt', 'text'),
 (1, 'mark', 'text'), (2, 'Order_NPI', 'text'), (2, 'Order_Pymt', 'text'), (2, 'note', 'object'),
 (3, 'Order_NPI', 'number'))
 SELECT field, kind, count(*) AS records FROM orders JOIN kinds ON shape = o_orderkey % 4
 WHERE o_orderkey % 28 <> 3 GROUP BY 1, 2""",
    "json_bad_records": """SELECT '{"Order_NPI": ' || o_orderkey AS line FROM orders WHERE o_orderkey % 28 = 3""",
    "missing_values": with_panel(MISSING),
    "fill_missing": with_panel(
        f"""SELECT "Suplr_NPI", year, coalesce({BENES[0]}, 0) AS {BENES[0]}, {CLAIMS[0]},
 CAST({CONDITION_COLUMNS[3]} AS DOUBLE) AS {CONDITION_COLUMNS[3]} FROM panel
 WHERE {CONDITION_COLUMNS[3]} IS NOT NULL"""
    ),
    "drop_duplicates": """SELECT o_custkey, o_orderkey, o_orderpriority, o_totalprice FROM orders
 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) = 1""",
    "describe": DESCRIBE,
    "correlation": CORRELATION,
    "panel_correlation": PANEL_CORRELATION,
    "outliers": """WITH fences AS (SELECT l_returnflag AS flag,
 quantile_disc(l_extendedprice, 0.25) AS q1, quantile_disc(l_extendedprice, 0.75) AS q3
 FROM lineitem GROUP BY 1)
 SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_extendedprice
 FROM lineitem JOIN fences ON l_returnflag IS NOT DISTINCT FROM flag
 WHERE l_extendedprice < q1 - 0.5 * (q3 - q1) OR l_extendedprice > q3 + 0.5 * (q3 - q1)""",
    "line_sums": """SELECT l_suppkey, CAST(sum(l_quantity::DECIMAL(18,2)) AS DOUBLE) AS quantity,
 CAST(sum(l_extendedprice::DECIMAL(18,2)) AS DOUBLE) AS extendedprice,
 count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1""",
    "line_shares": " UNION ALL ".join(
        f"""SELECT l_suppkey, 'Return flag' AS "group", CAST({i} AS INTEGER) AS ordinal,
 '{name}' AS label, round_even((count(*) FILTER ({test}))::DOUBLE / count(*)::DOUBLE * 100.0
 * 100.0, 0) / 100.0 AS pct FROM lineitem GROUP BY l_suppkey"""
        for i, (name, test) in enumerate(
            {
                "Returned": "l_returnflag = 'R'",
                "Accepted": "l_returnflag = 'A'",
                "Neither": "l_returnflag NOT IN ('R', 'A')",
            }.items(),
            1,
        )
    ),
    "line_means": " UNION ALL ".join(
        f"""SELECT l_suppkey, 'Rates' AS "group", CAST({i} AS INTEGER) AS ordinal,
 '{c.title()}' AS label, CAST(sum(l_{c}::DECIMAL(18,2) * l_quantity::DECIMAL(18,2)) AS DOUBLE)
 / CAST(sum(l_quantity::DECIMAL(18,2)) AS DOUBLE) AS value FROM lineitem GROUP BY l_suppkey"""
        for i, c in enumerate(("discount", "tax"), 1)
    ),
    "top_orders": """SELECT o_orderkey, o_custkey, o_totalprice, CAST(row_number() OVER (
 ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS INTEGER) AS rank FROM orders
 QUALIFY rank <= 100""",
    "order_change": """SELECT o_custkey, o_orderkey, o_totalprice, (o_totalprice / nullif(
 lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) - 1.0) * 100.0
 AS price_change FROM orders""",
    "line_change": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
 (l_extendedprice / nullif(lag(l_extendedprice) OVER (
 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice), 0) - 1.0) * 100.0 AS price_change FROM lineitem""",
    # as whole numbers of 2^-53 and 2^-60, the last binary places that these columns can have;
    # through text, which is rounded once
    "double_sums": """SELECT l_suppkey,
 CAST(CAST(sum(CAST(l_extendedprice * 9007199254740992 AS HUGEINT)) AS VARCHAR) AS DOUBLE)
 / 9007199254740992 AS l_extendedprice,
 CAST(CAST(sum(CAST(l_tax * 1152921504606846976 AS HUGEINT)) AS VARCHAR) AS DOUBLE)
 / 1152921504606846976 AS l_tax FROM lineitem GROUP BY 1""",
    "repeated_lines": """SELECT l_linenumber, l_returnflag, l_linestatus, l_quantity, l_discount, l_tax,
 count(*) AS lines FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
    "distinct_lines": """SELECT DISTINCT * REPLACE (CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS l_shipdate)
 FROM lineitem""",
    "order_features": """WITH earlier AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
 cuts AS (SELECT list_distinct([quantile_disc(o_totalprice, 0.25), quantile_disc(o_totalprice, 0.5),
 quantile_disc(o_totalprice, 0.75)]) AS cuts, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std FROM earlier),
 priorities AS (SELECT o_orderpriority AS p, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS code
 FROM earlier WHERE o_orderpriority IS NOT NULL GROUP BY 1 QUALIFY code <= 3),
 states AS (SELECT o_orderstatus AS s, row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) AS code
 FROM earlier WHERE o_orderstatus IS NOT NULL GROUP BY 1 QUALIFY code <= 5),
 customers AS (SELECT o_custkey AS c, avg(o_totalprice) AS own FROM earlier WHERE o_custkey IS NOT NULL GROUP BY 1)
 SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
 CAST(1 + len(list_filter(cuts, lambda x: x < o_totalprice)) AS INTEGER) AS o_totalprice_bin,
 CAST(coalesce(priorities.code, 0) AS INTEGER) AS o_orderpriority_code,
 CAST(coalesce(states.code, 0) AS INTEGER) AS o_orderstatus_code,
 round((o_totalprice - mean) / std, 5) AS o_totalprice_z,
 round(coalesce(own, mean), 5) AS o_totalprice_by_o_custkey
 FROM orders CROSS JOIN cuts LEFT JOIN priorities ON p = o_orderpriority LEFT JOIN states ON s = o_orderstatus
 LEFT JOIN customers ON c = o_custkey""",
    "full_report": _report(),
    "chart_bundle": _charts(),
}
