import pytest

from datalumen.plans.console import ReadOnlyError, check_read_only, query, try_query
from datalumen.sources.readers import load, read_database, typed


@pytest.mark.parametrize("sql", [
    "SELECT 1", " with a as (select 1) select * from a ; ", "(SELECT 1)", "VALUES (1)", "-- note\nSELECT 1",
    "SELECT replace(name, 'a', 'b') FROM t", "SELECT 'please update; drop it' AS x", "SELECT /* delete */ 1",
    "SELECT cache FROM t", "SELECT `update` FROM t", r"SELECT 'a\'; drop' AS x", "SELECT /* a /* ; */ b ; */ 1", "SELECT 'it''s; fine'"])
def test_allowed(sql):
    check_read_only(sql)


@pytest.mark.parametrize("sql", [
    "DROP TABLE t", "SELECT 1; DELETE FROM t", "INSERT INTO t VALUES (1)", "", "CREATE OR REPLACE VIEW v AS SELECT 1",
    "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "SELECT reflect('java.lang.System', 'exit', 0)",
    "SELECT * FROM parquet.`/etc`", "SET x = 1", "SELECT java_method('a', 'b')", "TRUNCATE TABLE t",
    r"SELECT '\\', reflect('java.util.UUID','randomUUID')", "SELECT `reflect`('java.util.UUID','randomUUID')",
    "SELECT * FROM `text`.`/etc/hostname`", "FROM t INSERT INTO u SELECT *", "SELECT /* /* */ ' */ reflect('a','b') -- '"])
def test_refused(sql):
    with pytest.raises(ReadOnlyError):
        check_read_only(sql)


def test_query_and_outcome(spark):
    t = spark.range(3)
    assert query(spark, "SELECT sum(id) AS s FROM numbers", {"numbers": t}).first()["s"] == 3
    good = try_query(spark, "SELECT id, id * 2 AS d FROM numbers", {"numbers": t})
    assert good.success and good.columns == ("id", "d") and good.n_rows == 3
    for bad in ("SELECT raise_error('at run time') FROM numbers", "SELECT nothing FROM numbers", "DROP VIEW numbers", "SELECT FROM WHERE"):
        outcome = try_query(spark, bad, {"numbers": t})
        assert not outcome.success and outcome.error


def test_database_queries_are_guarded(spark):
    with pytest.raises(ReadOnlyError):
        read_database(spark, "jdbc:none", "DELETE FROM t")


def test_types_of_text(spark):
    raw = spark.createDataFrame([("1", "1.5", "true", "x", "NA"), ("2", "NA", "False", "", None)],
                                "a string, b string, c string, d string, e string")
    out = typed(raw)
    assert [t for _, t in out.dtypes] == ["bigint", "double", "boolean", "string", "string"]
    assert out.filter("b IS NULL AND d IS NULL").count() == 1


def test_sources(spark, tmp_path):
    df = spark.range(3)
    assert load(spark, df) is df
    with pytest.raises(TypeError):
        load(spark, 5)
    with pytest.raises(ValueError):
        load(spark, "a.xlsx")
    path = tmp_path / "data.txt"
    path.write_text("a,b\n1,x\n2,y\n")
    assert load(spark, str(path)).dtypes == [("a", "bigint"), ("b", "string")]
    array = tmp_path / "data.json"
    array.write_text('[{"a": 1}, {"a": 2}]')
    assert load(spark, str(array), array=True).count() == 2


@pytest.mark.parametrize("sql", [
    "SELECT * FROM xml.`/etc/hostname`", "SELECT * FROM xml.`data.xml`", "SELECT * FROM a, xml . `/x/y`", "SELECT 1 FROM (xml.`rows.xml`)",
    "SELECT * FROM `org.apache.spark.sql.execution.datasources.text.TextFileFormat`.`/etc/hostname`",
    "SELECT * FROM `org.apache.spark.sql.execution.datasources.text.TextFileFormat`.rows", "WITH t AS (SELECT * FROM a JOIN custom.`x y`) SELECT * FROM t"])
def test_files_behind_any_format_are_refused(sql):
    with pytest.raises(ReadOnlyError):
        check_read_only(sql)


@pytest.mark.parametrize("sql", ["SELECT t.`a b`, t.`c.d` FROM `t`", "SELECT * FROM db.`sales` JOIN `x` ON `x`.`a b` = sales.k", "SELECT 'from x.`/y`' AS s FROM t"])
def test_quoted_names_are_allowed(sql):
    check_read_only(sql)


def test_json_arrays_and_lines_load_alike(spark, tmp_path):
    records = '{"a": 1, "b": "x"}', '{"a": 2, "b": "y"}'
    for name, text in (("lines.json", "\n".join(records)), ("array.json", "\n  [\n" + ",\n".join(records) + "\n]\n"), ("one.json", f"[{','.join(records)}]")):
        (tmp_path / name).write_text(text)
        assert sorted(map(tuple, load(spark, str(tmp_path / name)).collect())) == [(1, "x"), (2, "y")]
