"""The panel that follows its files, the tolerant load, and results committed as a set."""

import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from supplypanel import session
from supplypanel.plans import sinks
from supplypanel.sources import incremental, quarantine

TEMPLATE = "{root}/{year}/suppliers.csv"


def write(root, year, lines, header="Suplr_NPI,DME_Tot_Suplr_Benes"):
    os.makedirs(root / str(year), exist_ok=True)
    (root / str(year) / "suppliers.csv").write_text("\n".join([header, *lines]) + "\n")


def state(path):
    return {
        year: sorted((f, os.stat(path / year / f).st_mtime_ns) for f in os.listdir(path / year))
        for year in os.listdir(path)
        if year.startswith("year=")
    }


def refreshed(spark, root, path):
    return incremental.refresh_panel(spark, str(root), str(path), TEMPLATE)


def content(panel):
    return sorted((r.year, r.Suplr_NPI, r.DME_Tot_Suplr_Benes) for r in panel.data.collect())


def test_only_changed_years_are_written(spark, tmp_path):
    root, path = tmp_path / "files", tmp_path / "store"
    for year in (2018, 2019, 2020):
        write(root, year, [f"{year},1", "7,"])
    first = refreshed(spark, root, path)
    assert first.written == (2018, 2019, 2020) and first.panel.years == (2018, 2019, 2020)
    before = state(path)
    again = refreshed(spark, root, path)
    assert again.written == again.removed == () and state(path) == before
    write(root, 2019, ["2019,5", "8,2", "9,3"])
    write(root, 2021, ["2021,4,x"], "Suplr_NPI,DME_Tot_Suplr_Benes,Note")
    os.remove(root / "2018" / "suppliers.csv")
    os.rmdir(root / "2018")
    third = refreshed(spark, root, path)
    assert third.written == (2019, 2021) and third.removed == (2018,)
    after = state(path)
    assert after["year=2020"] == before["year=2020"] and after["year=2019"] != before["year=2019"]
    assert "year=2018" not in after
    assert content(third.panel) == [
        (2019, "2019", 5), (2019, "8", 2), (2019, "9", 3), (2020, "2020", 1), (2020, "7", None), (2021, "2021", 4),
    ]
    assert rows(third.panel.year(2021).select("Note")) == [("x",)]
    assert third.panel.year(2020).columns == ["Suplr_NPI", "DME_Tot_Suplr_Benes", "year"]
    assert content(incremental.stored_panel(spark, str(path))) == content(third.panel)


def test_a_failed_refresh_is_taken_up_again(spark, tmp_path, monkeypatch):
    root, path = tmp_path / "files", tmp_path / "store"
    write(root, 2018, ["1,1"])
    refreshed(spark, root, path)
    write(root, 2019, ["2,2"])
    own = incremental._write_manifest

    def broken(*_):
        raise OSError("lost")

    monkeypatch.setattr(incremental, "_write_manifest", broken)
    with pytest.raises(OSError, match="lost"):
        refreshed(spark, root, path)
    # readers see the years of the manifest only
    assert content(incremental.stored_panel(spark, str(path))) == [(2018, "1", 1)]
    monkeypatch.setattr(incremental, "_write_manifest", own)
    assert refreshed(spark, root, path).written == (2019,)
    assert content(incremental.stored_panel(spark, str(path))) == [(2018, "1", 1), (2019, "2", 2)]
    with pytest.raises(ValueError, match="no yearly file"):
        refreshed(spark, tmp_path / "nowhere", path)


def test_a_year_that_changes_its_types_is_refused(spark, tmp_path):
    root, path = tmp_path / "files", tmp_path / "store"
    write(root, 2018, ["1,1"])
    refreshed(spark, root, path)
    write(root, 2019, ["2,2"])
    with pytest.raises(ValueError, match="changes its type"):
        incremental.refresh_panel(
            spark, str(root), str(path), TEMPLATE, types={"DME_Tot_Suplr_Benes": "double"}
        )


def test_bad_records_are_kept_with_file_and_reason(spark, tmp_path):
    root = tmp_path / "files"
    write(root, 2018, ["1,1", "2,2,surplus", "3", '"4 ""x""",4'])
    write(root, 2019, ['"5', 'broken",5', "6,6"])
    write(root, 2020, ["7,7"])
    (root / "2021").mkdir()
    (root / "2021" / "suppliers.csv").write_text("")
    loaded = quarantine.load_tolerant(spark, str(root), str(tmp_path / "store"), template=TEMPLATE)
    assert loaded.panel.years == (2018, 2020)
    assert content(loaded.panel) == [(2018, "1", 1), (2018, "3", None), (2018, '4 "x"', 4), (2020, "7", 7)]
    bad = [tuple(r) for r in loaded.quarantine.collect()]
    by_year = {y: sorted(((r, t) for x, _, r, t in bad if x == y), key=repr) for y in {b[0] for b in bad}}
    assert by_year[2018] == [("more fields than the header", "2,2,surplus")]
    assert all(f.endswith("2018/suppliers.csv") for y, f, _, _ in bad if y == 2018)
    assert any(t is None and "line breaks" in r for r, t in by_year[2019])
    assert by_year[2021][0][1] is None
    assert loaded.counts["rows"] >= 4 and loaded.counts["left_out"] >= 2
    with pytest.raises(ValueError, match="no yearly file"):
        quarantine.load_tolerant(spark, str(tmp_path / "none"), str(tmp_path / "s2"), template=TEMPLATE)


def test_files_are_scanned_once(spark, tmp_path, monkeypatch):
    """The text is read by the one write; all else reads what it stored."""
    root = tmp_path / "files"
    for year in (2018, 2019):
        write(root, year, ["1,1", "2,2,surplus"])
    loaded = quarantine.load_tolerant(spark, str(root), str(tmp_path / "store"), template=TEMPLATE)
    for year in (2018, 2019):
        os.remove(root / str(year) / "suppliers.csv")
    assert loaded.panel.data.count() == 2 and loaded.quarantine.count() == 2


def test_a_failed_set_leaves_the_earlier_one(spark, tmp_path):
    folder = str(tmp_path / "out")
    one = {"a": spark.range(3), "b": spark.range(4)}
    sinks.save_result_set(one, folder)
    bad = spark.range(3).select(F.raise_error(F.lit("broken")).cast("int").alias("x"))
    with pytest.raises(Exception, match="broken"):
        sinks.save_result_set({"a": spark.range(9), "b": bad}, folder)
    saved = sinks.read_result_set(spark, folder)
    assert saved["a"].count() == 3 and saved["b"].count() == 4
    assert len([f for f in os.listdir(folder) if f.startswith("set-")]) == 1
    sinks.save_result_set({"a": spark.range(5)}, folder)
    newer = sinks.read_result_set(spark, folder)
    assert set(newer) == {"a"} and newer["a"].count() == 5
    assert saved["b"].count() == 4  # readers of the set before go on
    sinks.save_result_set({"a": spark.range(6)}, folder)
    assert len([f for f in os.listdir(folder) if f.startswith("set-")]) == 2
    with pytest.raises(ValueError, match="no results"):
        sinks.read_result_set(spark, str(tmp_path / "empty"))


class OnACluster:
    """The session as if its executors were on other machines, without a shared folder named."""

    def __init__(self, spark, warehouse):
        self._spark, self._jvm, self._jsc = spark, spark._jvm, spark._jsc
        self.sparkContext = type("Context", (), {"master": "yarn"})
        get = {"spark.sql.warehouse.dir": warehouse}.get
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: get(key, default))})


def test_scratch_on_a_cluster_is_shared(spark, tmp_path):
    for local in (str(tmp_path), f"file:{tmp_path}"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.scratch_folder(OnACluster(spark, local), "x")
    assert session._own_disk(spark, str(tmp_path))
