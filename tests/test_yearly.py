"""Yearly files: discovery, typing, drifting headers, the stored panel and the report."""

import json
import os
import warnings

import pytest
from conftest import plan_of, rows

from supplypanel.plans import report, sinks
from supplypanel.sources import yearly
from supplypanel.sources.dictionary import DEMOGRAPHIC_GROUPS

DEMOGRAPHICS = [c for names in DEMOGRAPHIC_GROUPS.values() for c in names]
HEADER = [
    "Suplr_NPI",
    "Suplr_Prvdr_Last_Name_Org",
    "Suplr_Prvdr_State_Abrvtn",
    "Suplr_Prvdr_Zip5",
    "Suplr_Prvdr_RUCA_Desc",
    "DME_Sprsn_Ind",
    "DME_Tot_Suplr_Benes",
    "DME_Tot_Suplr_Clms",
    "DME_Suplr_Mdcr_Pymt_Amt",
    "POS_Suplr_Mdcr_Pymt_Amt",
    "Drug_Suplr_Mdcr_Pymt_Amt",
    *DEMOGRAPHICS,
    "Bene_CC_PH_Asthma_V2_Pct",
    "Bene_CC_PH_CKD_V2_Pct",
    "Bene_CC_BH_PD_V1_Pct",
]
COUNTS = "1,2,3,4,5,6,1,2,3,4,0,0"


def write(root, year, lines, header=HEADER):
    path = yearly.year_path(str(root), year)
    os.makedirs(os.path.dirname(path))
    with open(path, "w") as f:
        f.write("\n".join([",".join(header), *lines]) + "\n")
    return path


@pytest.fixture
def folder(tmp_path):
    """2021 and 2022, of 2017-2022; the later file has one more column in the middle."""
    write(
        tmp_path,
        2021,
        [
            f'1,None,NY,01234,Urban,,20,40,100,1,2,{COUNTS},3.5,10,1',
            f'2,"Smith, ""Al""",,00501,Rural,*,,5, 7 ,*,1e3,{COUNTS},,,',
        ],
    )
    wider = [*HEADER[:3], "New_Column", *HEADER[3:]]
    write(
        tmp_path,
        2022,
        [
            f'1,Acme,NY,x,01234,Urban,,11,44,1000.5,5,6,{COUNTS},0.2,20,2',
            f'2,Beta,CA,x,00501,Urban,#,15.0,6,"1,234",,3,{COUNTS},,10,',
            f'3,NA,NY,x,99999,Rural,*,11,7,$5,nan,1d,{COUNTS},50,,4',
            f'4,Delta,,x,10000,,*,,,,,,,,,,,,,,,,,,,,',
        ],
        wider,
    )
    return tmp_path


def load(spark, folder, **options):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return yearly.load_panel(spark, str(folder), **options)


def test_years_asked_for_and_absent_are_a_warning(spark, folder):
    with pytest.warns(UserWarning, match="no data for 2020"):
        assert yearly.load_panel(spark, str(folder), range(2020, 2023)).years == (2021, 2022)


def test_load_panel(spark, folder):
    panel = load(spark, folder)
    assert panel.years == (2021, 2022)
    assert panel.latest_year == 2022
    assert panel.data.columns == [*HEADER, "year", "New_Column"]
    types = dict(panel.data.dtypes)
    assert types["Suplr_Prvdr_Zip5"] == types["Suplr_NPI"] == "string"
    assert types["DME_Tot_Suplr_Benes"] == "bigint" and types["year"] == "int"
    assert types["DME_Suplr_Mdcr_Pymt_Amt"] == types["Bene_CC_PH_CKD_V2_Pct"] == "double"
    columns = [
        "Suplr_Prvdr_Last_Name_Org",
        "Suplr_Prvdr_State_Abrvtn",
        "Suplr_Prvdr_Zip5",
        "DME_Tot_Suplr_Benes",
        "DME_Suplr_Mdcr_Pymt_Amt",
        "POS_Suplr_Mdcr_Pymt_Amt",
        "Drug_Suplr_Mdcr_Pymt_Amt",
        "New_Column",
    ]
    assert rows(panel.data.where("year = 2021").orderBy("Suplr_NPI").select(columns)) == [
        (None, "NY", "01234", 20, 100.0, 1.0, 2.0, None),
        ('Smith, "Al"', None, "00501", None, 7.0, None, 1000.0, None),
    ]
    assert panel.latest().columns == [*HEADER[:3], "New_Column", *HEADER[3:], "year"]
    assert panel.year(2021).columns == [*HEADER, "year"]
    assert rows(panel.latest().orderBy("Suplr_NPI").select(columns)) == [
        ("Acme", "NY", "01234", 11, 1000.5, 5.0, 6.0, "x"),
        ("Beta", "CA", "00501", 15, None, None, 3.0, "x"),
        (None, "NY", "99999", 11, None, None, None, "x"),
        ("Delta", None, "10000", None, None, None, None, "x"),
    ]


def test_absent_years(spark, folder, tmp_path_factory):
    panel = load(spark, folder)
    with pytest.raises(ValueError):
        panel.year(2020)
    with pytest.raises(ValueError, match="no yearly file"):
        load(spark, tmp_path_factory.mktemp("empty"))


def test_one_year_reads_one_file_and_few_columns(spark, folder):
    latest = load(spark, folder).latest().select("DME_Tot_Suplr_Benes")
    plan = plan_of(latest)
    assert plan.count("FileScan csv") == 1
    assert "ReadSchema: struct<Suplr_NPI:string,DME_Tot_Suplr_Benes:string,_bad_record:string>" in plan


def test_headers_that_disagree_within_a_year_fail(spark, tmp_path):
    folder = tmp_path / "table"
    folder.mkdir()
    (folder / "part-0.csv").write_text("a,b\n" + "1,2\n" * 3)
    (folder / "part-1.csv").write_text("a,c,b\n1,3,2\n")
    table = yearly.read_table(spark, str(folder))
    for columns in (["a", "b"], ["b"], ["a"]):
        with pytest.raises(Exception, match="(?i)header"):
            table.select(*columns).collect()


def test_unreadable_file(spark, folder):
    empty = yearly.year_path(str(folder), 2020)
    os.makedirs(os.path.dirname(empty))
    open(empty, "w").close()
    with pytest.raises(ValueError, match="no header"):
        load(spark, folder)
    assert load(spark, folder, strict=False).years == (2021, 2022)


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('Suplr_NPI,Name,A_Cnt\n1,"two\nlines",5\n2,x,6\n')
    out = yearly.read_table(spark, str(path), multiline=True).orderBy("Suplr_NPI")
    assert rows(out) == [("1", "two\nlines", 5), ("2", "x", 6)]


def test_byte_order_mark_and_short_lines(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("\ufeffSuplr_NPI,A_Cnt,B_Cnt\n1,2,3\n\n4,5\n")
    out = yearly.read_table(spark, str(path))
    assert out.columns == ["Suplr_NPI", "A_Cnt", "B_Cnt"]
    assert sorted(rows(out)) == [("1", 2, 3), ("4", 5, None)]


BROKEN = 'A,B_Cnt,C\n"x, ""y""",1,2\n2,3,4,EXTRA\n"line\nbreak",4,5\n5\n'


def test_records_that_do_not_fit_fail(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text('A,B_Cnt\n1,2\n2,3,EXTRA\n')
    for column in ("A", "B_Cnt"):
        with pytest.raises(Exception, match="more fields than the header: 2,3,EXTRA"):
            yearly.read_table(spark, str(path)).select(column).collect()
    path.write_text('A,B_Cnt\n"line\nbreak",4\n')
    with pytest.raises(Exception, match="multiline=True"):
        yearly.read_table(spark, str(path)).collect()
    whole = yearly.read_table(spark, str(path), multiline=True)
    assert rows(whole) == [("line\nbreak", 4)]


def test_records_that_do_not_fit_are_kept_aside(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text(BROKEN)
    out = yearly.read_text_table(spark, str(path), bad="keep")
    good = out.where(f"{yearly.BAD_RECORD} is null").drop(yearly.BAD_RECORD)
    assert sorted(rows(good), key=repr) == [("5", None, None), ('break"', "4", "5"), ('x, "y"', "1", "2")]
    # the second half of a broken record may look whole; the first half shows the fault
    assert [r[0] for r in rows(out.select(yearly.BAD_RECORD)) if r[0]] == ["2,3,4,EXTRA", '"line']


def test_tolerant_load_counts_what_it_leaves_out(spark, tmp_path):
    (tmp_path / "2020.csv").write_text("A,B_Cnt\n1,2\n2,3,EXTRA\n")
    (tmp_path / "2021.csv").write_text('A,B_Cnt\n1,"x\ny"\n')
    (tmp_path / "2022.csv").write_text("A,B_Cnt\n7,8\n")
    with pytest.warns(UserWarning) as caught:
        panel = yearly.load_panel(spark, str(tmp_path), template="{root}/{year}.csv", strict=False)
    said = " ".join(str(w.message) for w in caught)
    assert "1 records of" in said and "no data for 2021" in said and "multiline" in said
    assert sorted(rows(panel.data.select("year", "A", "B_Cnt"))) == [(2020, "1", 2), (2022, "7", 8)]


def test_years_are_discovered(spark, tmp_path):
    for year in (1998, 2023):
        (tmp_path / f"{year}.csv").write_text("A\n1\n")
    (tmp_path / "notes.csv").write_text("A\n1\n")
    panel = yearly.load_panel(spark, str(tmp_path), template="{root}/{year}.csv")
    assert panel.years == (1998, 2023)
    with pytest.warns(UserWarning, match="2023.csv is not asked for"):
        yearly.load_panel(spark, str(tmp_path), [1998], "{root}/{year}.csv")


def test_long_counts_are_exact(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("A_Cnt\n1000000000000000001\n+12.0\n1e3\n")
    assert sorted(rows(yearly.read_table(spark, str(path)))) == [(12,), (1000,), (1000000000000000001,)]


def test_columns_absent_from_the_latest_year(spark, tmp_path):
    """A column that only earlier files have is not reported for the latest year."""
    first = [*HEADER, "Bene_CC_BH_PTSD_V1_Pct"]
    write(tmp_path, 2021, [f"1,A,NY,0,Urban,,20,40,100,1,2,{COUNTS},1,2,3,4"], first)
    gone = [c for c in HEADER if c != "Suplr_Prvdr_RUCA_Desc"]
    write(tmp_path, 2022, [f"1,A,NY,0,,20,40,100,1,2,{COUNTS},1,2,3"], gone)
    tables = report.report_tables(load(spark, tmp_path)).tables
    assert tables["conditions"].count() == 3
    assert rows(tables["ruca_share"]) == []
    sizes = dict(rows(tables["categories"].select("category", "columns")))
    assert sizes["Supplier Information"] == 4
    assert sizes["Beneficiary Behavioral Health Conditions"] == 1


def test_type_overrides(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("A_Cnt,B_Pct\n1.5,2\n")
    out = yearly.read_table(spark, str(path), types={"A_Cnt": "double", "B_Pct": "string"})
    assert rows(out) == [(1.5, "2")]


def test_json_lines(spark, tmp_path):
    for year, benes in ((2021, 12), (2022, "7")):
        path = tmp_path / f"{year}.json"
        path.write_text(json.dumps({"Suplr_NPI": "01", "DME_Tot_Suplr_Benes": benes}) + "\n")
    panel = load(spark, tmp_path, template="{root}/{year}.json", fmt="json")
    assert sorted(rows(panel.data.select("year", "Suplr_NPI", "DME_Tot_Suplr_Benes"))) == [
        (2021, "01", 12),
        (2022, "01", 7),
    ]


def test_shape(spark, folder):
    panel = load(spark, folder)
    assert rows(yearly.shape(panel.latest())) == [(4, len(HEADER) + 2)]
    assert rows(yearly.shape(panel.year(2021))) == [(2, len(HEADER) + 1)]


def test_report(spark, folder, tmp_path_factory):
    work = tmp_path_factory.mktemp("work")
    result = report.run_report(spark, str(folder), out=f"{work}/out", store=f"{work}/panel")
    assert result.panel.years == (2021, 2022)
    saved = sinks.read_result_set(spark, f"{work}/out")
    for name, table in result.tables.items():
        assert sorted(map(repr, rows(table))) == sorted(map(repr, rows(saved[name])))

    tables = {name: table for name, table in saved.items()}
    assert rows(tables["overview"].orderBy("Year")) == [
        (2021, 2, 20, 45, 107.0),
        (2022, 4, 37, 57, 1000.5),
    ]
    assert rows(tables["spending"].orderBy("Year")) == [
        (2021, 20, 107.0, 5.35, 107.0, 1.0, 1002.0),
        (2022, 37, 1000.5, 1000.5 / 37, 1000.5, 5.0, 9.0),
    ]
    assert dict(rows(tables["two_year_change"])) == {
        "Suppliers": 100.0,
        "Beneficiaries": 85.0,
        "Claims": pytest.approx(100 * 12 / 45),
        "Payments": pytest.approx(100 * 893.5 / 107),
    }
    assert [r[:3] for r in rows(tables["top_suppliers"])] == [
        ("Beta", 15, 6),
        ("Acme", 11, 44),
        (None, 11, 7),
        ("Delta", None, None),
    ]
    means = {r["label"]: r["value"] for r in tables["conditions"].collect()}
    assert means == {
        "Percent with Asthma": pytest.approx((0.2 * 11 + 50 * 11) / 37),
        "Percent with Chronic Kidney Disease": pytest.approx((20 * 11 + 10 * 15) / 37),
        "Percent with Personality Disorders": pytest.approx((2 * 11 + 4 * 11) / 37),
    }
    best = tables["top_conditions"].where("rank = 1").orderBy("group").select("label")
    assert [r[0] for r in best.collect()] == [
        "Percent with Personality Disorders",
        "Percent with Asthma",
    ]
    ages = tables["demographics"].where("group = 'Age Distribution'").orderBy("ordinal")
    assert [r["pct"] for r in ages.collect()] == [10.0, 20.0, 30.0, 40.0]
    assert rows(tables["top_states"]) == [("NY", 2), ("CA", 1)]
    assert sorted(rows(tables["ruca_share"].select("RUCA Description", "slice"))) == [
        ("Rural", "33.3%"),
        ("Urban", "66.7%"),
    ]
    printed = rows(report.report_lines(result.tables).orderBy("section_no", "line"))
    assert [r[1] for r in printed if r[0] == 1] == list(range(1, 9))
    lines = {tuple(r[2:5]): r[5] for r in printed}
    assert lines["Spending", "2,022", "Spending Per Beneficiary"] == "$27.04"
    assert lines["Overview", "2021", "Total Payments ($)"] == "107"
    assert lines["Change", "Change 2021-2022 (%)", "Beneficiaries"] == "85.00%"
    assert lines["Column categories", "Durable Medical Equipment", "columns"] == "4"
    described = lines["Column categories", "Supplier Information", "Suplr_NPI"]
    assert described.startswith("Supplier NPI - ")


def test_report_on_files_and_on_stored_panel_agree(spark, folder, tmp_path_factory):
    panel = load(spark, folder)
    stored = yearly.store_panel(panel, f"{tmp_path_factory.mktemp('store')}/panel")
    direct = report.report_tables(panel).tables
    for name, table in report.report_tables(stored).tables.items():
        assert sorted(map(repr, rows(table))) == sorted(map(repr, rows(direct[name])))


def test_stored_panel_is_pruned_by_year(spark, folder, tmp_path_factory):
    panel = load(spark, folder)
    stored = yearly.store_panel(panel, f"{tmp_path_factory.mktemp('store')}/panel")
    plan = plan_of(stored.latest().select("DME_Tot_Suplr_Benes"))
    assert "PartitionFilters: [isnotnull(year" in plan
    assert "ReadSchema: struct<DME_Tot_Suplr_Benes:bigint>" in plan


def test_save_as_text(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "`x y` int, b string")
    paths = sinks.save_results({"t": df}, str(tmp_path), fmt="csv")
    assert rows(sinks.read_results(spark, paths, fmt="csv")["t"]) == [("1", "a")]
