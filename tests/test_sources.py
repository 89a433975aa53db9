from concurrent.futures import ThreadPoolExecutor

import pytest

from conftest import rows
from flowgauge.errors import HeaderMismatch
from flowgauge.operators.columns import standardize_columns
from flowgauge.sources import flow_csv, relabel, store
from flowgauge.sources.names import COLUMN_MAP


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


HEADER = " Flow Duration, Fwd Header Length, Fwd Header Length,Flow Bytes/s, Label\n"


def test_repeated_headers_get_a_copy_suffix():
    assert flow_csv.header_names(HEADER.strip("\n")) == [
        " Flow Duration", " Fwd Header Length", " Fwd Header Length.1", "Flow Bytes/s", " Label"]


def test_numbers_in_all_spellings(spark, tmp_path):
    path = write(tmp_path / "a.csv", HEADER + "1,2,3,Infinity,x\n4,5,6,inf,y\n7,8,9,NaN,z\n,,,-Infinity,\n")
    df = standardize_columns(flow_csv.read_flow_csv(spark, path), COLUMN_MAP)
    assert df.dtypes == [("flow_duration", "double"), ("fwd_header_len", "double"), ("flow_byts_s", "double"),
                         ("label", "string")]
    assert [str(r.flow_byts_s) for r in df.orderBy("flow_duration").collect()] == ["-inf", "inf", "inf", "nan"]


def test_each_file_has_its_own_encoding(spark, tmp_path):
    first = write(tmp_path / "a.csv", HEADER + "1,2,3,4,Web Attack – XSS\n5,6,7,8,real �\n")
    second = write(tmp_path / "b.csv", HEADER + "1,2,3,4,caf\xe9 \x96\n", "latin1")
    df = flow_csv.read_flow_csv(spark, [first, second])
    assert rows(df, "` Label`") == [("Web Attack – XSS",), ("caf\xe9 \x96",), ("real �",)]
    named = flow_csv.read_flow_csv(spark, second, encoding=flow_csv.LATIN1)
    assert rows(named, "` Label`") == [("caf\xe9 \x96",)]


def test_files_with_another_header_are_refused(spark, tmp_path):
    first = write(tmp_path / "a.csv", HEADER + "1,2,3,4,x\n")
    second = write(tmp_path / "b.csv", "Label,Other\nx,1\n")
    with pytest.raises(HeaderMismatch):
        flow_csv.read_flow_csv(spark, [first, second])
    with pytest.raises(HeaderMismatch):
        flow_csv.read_flow_csv(spark, write(tmp_path / "c.csv", ""))


@pytest.mark.parametrize("encoding", ["auto", flow_csv.LATIN1])
def test_swapped_columns_are_refused_in_any_encoding(spark, tmp_path, encoding):
    first = write(tmp_path / "a.csv", "x,y,Label\n1,2,p\n", "latin1")
    second = write(tmp_path / "b.csv", "y,x,Label\n2,1,caf\xe9\n", "latin1")
    with pytest.raises(HeaderMismatch, match="b.csv"):
        flow_csv.read_flow_csv(spark, [first, second], encoding=encoding)


def test_many_small_files(spark, tmp_path):
    for i in range(1000):
        write(tmp_path / f"s{i}.csv", f"x,Label\n{i},caf\xe9\n", "latin1" if i % 2 else "utf-8")
    df = flow_csv.read_flow_csv(spark, str(tmp_path / "*.csv"), source_column="source")
    found = df.groupBy("Label").count().collect()
    assert [tuple(r) for r in found] == [("caf\xe9", 1000)]
    assert df.agg({"x": "sum"}).first()[0] == 499500 and df.select("source").distinct().count() == 1000


def test_inferred_numbers(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'Proto,Size,Label\ntcp,1,x\nudp,inf,"a,""b"""\n')
    df = flow_csv.read_flow_csv(spark, path, numbers="inferred")
    assert df.dtypes == [("Proto", "string"), ("Size", "double"), ("Label", "string")]
    assert rows(df, "Label") == [('a,"b"',), ("x",)]


def test_relabel_files(spark, tmp_path):
    text = "Dur,Label\n1,0\n2,1\n3,1\n"
    paths = [write(tmp_path / f"{name}_set.csv", text) for name in ("hydra", "sqlmap", "other")]
    out = str(tmp_path / "out")
    relabel.relabel_files(spark, paths, out)
    df = spark.read.parquet(out)
    assert sorted(df.columns) == ["Dur", "Label", "source"]
    assert rows(df.groupBy("source", "Label").count()) == [
        ("hydra", "hydra", 2), ("hydra", "normal", 1), ("other", "1", 2), ("other", "normal", 1),
        ("sqlmap", "normal", 1), ("sqlmap", "sqli", 2)]


def test_savers_at_once_get_a_version_each(spark, tmp_path):
    path = str(tmp_path / "saved")
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda i: store._save(spark, path, {"table": spark.range(i, i + 1)}), range(8)))
    assert sorted(numbers) == list(range(1, 9))
    versions = store._versions(spark, path).collect()
    assert [v.number for v in versions] == list(range(8, 0, -1))
    kept = {v.number: spark.read.parquet(f"{path}/{v.name}/table").first().id for v in versions}
    assert kept == {n: i for i, n in enumerate(numbers)}
    assert store._current(spark, path).endswith(versions[0].name)
