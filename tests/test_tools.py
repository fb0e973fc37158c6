"""Mirror, sources, sinks, cleaners and commands."""

import zipfile
from datetime import date, datetime

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from plumbline.cli import main
from plumbline.errors import ConfigError, PlumbError, PushRefused, SourceError
from plumbline.operators import cleaners
from plumbline.session import Workspace
from plumbline.sources import csvfile, jdbc, push, xlsx
from plumbline.sources.config import Source, find_config, load_config
from plumbline.sources.frames import from_spark, to_spark

PROJECT = """
sources: {db: {server: 'localhost,1433', database: D, auth: {user: sa, password_env: PW}}}
destination: {path: store}
push: {allow: [Sand.dbo]}
tables:
  - {name: t1, source: {query: SELECT 1}, description: The first.}
  - {name: t2, schema: core, mode: parquet, compression: snappy, source: {database: D, schema: dbo, table: T2}}
semantics: {dir: models, fiscal_year_start: 7}
"""


@pytest.fixture
def project(tmp_path):
    (tmp_path / "plumbline.yaml").write_text(PROJECT)
    (tmp_path / "models").mkdir()
    (tmp_path / "models" / "m.yml").write_text("m: {fact: main.t1, time: {column: d}, dimensions: {k: k}, measures: {n: {expr: count(*), description: x}}}")
    return tmp_path


def test_split_of_an_extract(project):
    text = PROJECT.replace("{name: t1, source: {query: SELECT 1}, description: The first.}", "{name: t1, source: {query: SELECT 1}, extract: {split_by: id, bounds: [1, 900], parts: 3}}")
    (project / "split.yaml").write_text(text)
    t = load_config(project / "split.yaml").tables[0]
    assert (t.split_by, t.bounds, t.parts, t.batch_size) == ("id", ("1", "900"), 3, 100_000)
    (project / "split.yaml").write_text(text.replace(", bounds: [1, 900]", ""))
    with pytest.raises(ConfigError, match="split_by"):
        load_config(project / "split.yaml")


class Extract:
    def __init__(self):
        self.n, self.fail, self.seen = 1, None, []

    def __call__(self, spec):
        self.seen.append(spec.name)
        if spec.name == self.fail:
            raise RuntimeError("connection lost")
        return pa.table({"d": [date(2026, 1, 1)] * self.n, "k": ["a"] * self.n})


def test_config(project, monkeypatch):
    c = load_config(project / "plumbline.yaml")
    assert [t.qualified for t in c.tables] == ["main.t1", "core.t2"] and c.tables[1].sql == "SELECT * FROM [D].[dbo].[T2]" and c.fiscal_start == 7
    assert find_config(project / "models") == (project / "plumbline.yaml").resolve()
    with pytest.raises(ConfigError, match="PW is not set"):
        c.sources["db"].connection()
    monkeypatch.setenv("PW", "x")
    url, props = c.sources["db"].connection()
    assert url == "jdbc:sqlserver://localhost:1433;databaseName=D;encrypt=true" and props["password"] == "x"
    for old, new, say in (("name: t1", "nome: t1", "name"), ("compression: snappy", "compression: zip", "zip"), ("Sand.dbo", "Sand", "Database.schema"), ("query: SELECT 1", "query: SELECT 1, table: x", "either"), ("fiscal_year_start: 7", "fiscal_year_start: true", "month"), ("path: store", "pfad: x", "destination.path"), ("name: t2, schema: core", "name: t1", "twice")):
        (project / "bad.yaml").write_text(PROJECT.replace(old, new))
        with pytest.raises(ConfigError, match=say):
            load_config(project / "bad.yaml")


def test_mirror_publishes_whole_versions(spark, project):
    x = Extract()
    w = Workspace(project / "plumbline.yaml", spark, extract=x)
    with pytest.raises(PlumbError, match="nothing is mirrored"):
        w.freshness()
    spark.sql("CREATE DATABASE IF NOT EXISTS main")
    spark.sql("DROP TABLE IF EXISTS main.t1")
    w.mirror()
    assert w.table("t1").count() == 1 and [r["row_count"] for r in w.freshness().collect()] == [1, 1]
    assert w.store.register() == ["main.t1"] and spark.table("main.t1").count() == 1 and spark.sql("DESCRIBE TABLE EXTENDED main.t1").where("col_name = 'Comment'").first()["data_type"] == "The first."
    old = w.model("m").slice("n")
    x.n, x.fail = 3, "t2"
    with pytest.raises(SourceError, match="not changed"):
        w.mirror()
    assert w.table("t1").count() == 1 and len(list((project / "store" / "versions").iterdir())) == 1
    x.fail, x.seen = None, []
    w.mirror(only=["t1"])
    assert x.seen == ["t1"] and w.table("main.t1").count() == 3 and w.table("core.t2").count() == 1
    assert old.df.first()["n"] == 1 and w.model("m").slice("n").df.first()["n"] == 3  # a slice keeps the version it was made on
    assert w.model("m").slice("n").provenance().data["refreshed"]["main.t1"]
    with pytest.raises(PlumbError, match="declared"):
        w.mirror(only=["zz"])
    x.n = 4
    w.mirror()
    assert len(w.store.vacuum()) == 2 and w.table("t1").count() == 4


def test_tables_of_others_stay(spark, project):
    w = Workspace(project / "plumbline.yaml", spark, extract=Extract())
    spark.sql("CREATE DATABASE IF NOT EXISTS main")
    spark.sql("DROP TABLE IF EXISTS main.t1")
    spark.range(7).write.saveAsTable("main.t1")
    with pytest.warns(UserWarning, match="left alone"):
        w.mirror()
    assert spark.table("main.t1").count() == 7 and w.table("t1").count() == 1
    spark.sql("DROP TABLE main.t1")
    w.mirror()
    assert spark.table("main.t1").count() == 1


def test_builds_side_by_side(spark, project):
    """A build that is published while another one writes is not lost, and a lock left by a dead one is taken over."""
    x = Extract()
    w = Workspace(project / "plumbline.yaml", spark, extract=x)
    w.mirror()

    def slow(spec):
        x.n = 5
        Workspace(project / "plumbline.yaml", spark, extract=x).mirror(only=["t2"])
        return pa.table({"d": [date(2026, 1, 1)] * 2, "k": ["b"] * 2})

    w._extract = slow
    w.mirror(only=["t1"])
    assert w.table("t1").count() == 2 and w.table("core.t2").count() == 5
    lock = w.store._pointer + ".lock"
    w.store.files._system(lock).create(w.store.files._path(lock)).close()
    with w.store.files.held(lock, patience_s=0.3):
        assert w.store.files.exists(lock)
    assert not w.store.files.exists(lock)


def test_landing_survives_a_cut(spark, project):
    w = Workspace(project / "plumbline.yaml", spark, extract=Extract())
    w.land_stream(iter([pa.record_batch({"a": [1]})]), "cut_off")
    spark.sql("ALTER TABLE cut_off RENAME TO cut_off__before")  # as a crash between two renames leaves it

    def broken():
        yield pa.record_batch({"a": [2, 3]})
        raise RuntimeError("gone")

    with pytest.raises(RuntimeError):
        w.land_stream(broken(), "cut_off")
    assert spark.table("cut_off").count() == 1


def test_readers_without_a_project(spark, tmp_path, monkeypatch):
    import plumbline as pl

    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(pl, "_default", None)
    (tmp_path / "x.csv").write_text("a;b\n1;u\n2;v\n")
    assert pl.read_csv(tmp_path / "x.csv", backend="pyarrow").to_pylist() == [{"a": 1, "b": "u"}, {"a": 2, "b": "v"}]
    workbook(tmp_path / "x.xlsx", {"S": [["n", "m"], ["a", 1]]})
    assert pl.read_excel(tmp_path / "x.xlsx").collect()[0]["n"] == "a"
    with pytest.raises(ConfigError, match="land="):
        pl.read_csv(tmp_path / "x.csv", land="t")


def test_choices(spark):
    from plumbline import showcase

    sf = "/root/testdata/sf0.001"
    m = showcase.bound(spark, sf, "sales")
    flags, days = m.filter_dim("flag", label="Flag"), m.filter_date()
    assert flags.label == "Flag" and list(flags.options) == sorted(flags.options) and flags.value == [] and days.value == (days.start, days.stop) == m.date_range()


def test_widest_slice_is_checked(spark):
    """Each part fits by itself, but not all of them together."""
    from dataclasses import replace

    from plumbline import showcase
    from plumbline.errors import SemanticsError
    from plumbline.plans.slices import BoundModel

    m = showcase.bound(spark, "/root/testdata/sf0.001", "sales")
    supplier = m.read("supplier").selectExpr("*", "parse_json('1') AS span")  # a column like any other, but none to group by
    read = lambda t: supplier if t == "supplier" else m.read(t)
    shared = replace(m.model.dims["supplier"].shared, attributes={"span": "span"})
    bad = replace(m.model, dims={"supplier": replace(m.model.dims["supplier"], shared=shared)})
    with pytest.raises(SemanticsError, match="widest"):
        BoundModel(spark, bad, read)


def test_commands(spark, project, capsys):
    w = Workspace(project / "plumbline.yaml", spark, extract=Extract())
    assert main(["validate"], w) == 0 and main(["mirror", "--only", "t1"], w) == 0
    assert "main.t1: 1 rows" in capsys.readouterr().out
    assert main(["mirror", "--only", "t1", "--only", "t2"], w) == 0
    w.mirror, made = (lambda only, keep: made.append(only) or {"tables": {}}), []
    assert main(["mirror", "--only", "a", "--only", "b", "c"], w) == 0 and made == [["a", "b", "c"]]
    del w.mirror
    assert main(["mirror", "--only", "zz"], w) == 2 and "error:" in capsys.readouterr().err
    assert main(["--config", str(project / "none.yaml"), "validate"]) == 2


def test_land_register_and_streams(spark, project):
    w = Workspace(project / "plumbline.yaml", spark, extract=Extract())
    batches = [pa.record_batch({"a": [1, 2]}), pa.record_batch({"a": [3, 4]}), pa.record_batch({"a": [5, 6]})]
    assert w.land_stream(pa.RecordBatchReader.from_batches(batches[0].schema, batches), "landed") == 6
    assert w.land_stream(iter(batches[:1]), "landed") == 2 and spark.table("landed").count() == 2

    def broken():
        yield batches[0]
        raise RuntimeError("gone")

    with pytest.raises(RuntimeError):
        w.land_stream(broken(), "landed")
    assert spark.table("landed").count() == 2
    with pytest.raises(PlumbError, match="_mirror"):
        w.land_stream(iter(batches), "_mirror.meta")
    w.register([{"a": 1}], "reg")
    assert spark.sql("select a from reg").first()[0] == 1


def test_frames(spark):
    import pandas as pd

    for f in (pa.table({"a": [1]}), pa.record_batch({"a": [1]}), pd.DataFrame({"a": [1]}), [{"a": 1}], spark.range(1).toDF("a").selectExpr("a + 1 as a")):
        df = to_spark(spark, f)
        assert df.first()["a"] == 1 and from_spark(df, "pyarrow").num_rows == 1 and len(from_spark(df, "pandas")) == 1 and from_spark(df) is df
    with pytest.raises(SourceError):
        to_spark(spark, 3)
    with pytest.raises(SourceError):
        from_spark(df, "excel")


def test_jdbc_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(100).selectExpr("id as ID", "id % 3 as K").write.jdbc(url, "T1", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    s = Source("d", "jdbc", url=url)
    assert jdbc.read_query(spark, s, "SELECT * FROM T1 WHERE K = 1").count() == 33
    split = jdbc.read_query(spark, s, "SELECT * FROM T1", split_by="ID", bounds=(0, 100), parts=4)
    assert split.count() == 100 and split.rdd.getNumPartitions() == 4
    with pytest.raises(SourceError):
        jdbc.read_query(spark, s, "SELECT * FROM NOSUCH").count()


class Connection:
    def __init__(self, exists=0, fail=False):
        self.exists, self.fail, self.log = exists, fail, []

    def cursor(self):
        return self

    def execute(self, sql, args=None):
        self.log.append(sql)

    def fetchone(self):
        return (self.exists,)

    def executemany(self, sql, rows):
        if self.fail:
            raise RuntimeError("full")
        self.log.append((sql, list(rows)))

    def commit(self):
        self.log.append("commit")

    def rollback(self):
        self.log.append("rollback")

    def close(self):
        self.log.append("close")


def test_push_over_jdbc(spark, tmp_path):
    """The connection that push opens by itself: one transaction, values of every kind."""
    from decimal import Decimal

    source = Source("d", "jdbc", url=f"jdbc:derby:{tmp_path}/pushed;create=true")
    connection = jdbc.Connection(spark, source)
    cursor = connection.cursor()
    cursor.execute("CREATE TABLE t (a INT, b VARCHAR(20), c DATE, d TIMESTAMP, e DECIMAL(9,2), f DOUBLE)")
    connection.commit()
    rows = [(1, "x", date(2026, 1, 2), datetime(2026, 1, 2, 3, 4, 5), Decimal("1.50"), 0.5), (2, None, None, None, None, None)]
    cursor.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?)", rows)
    connection.rollback()
    cursor.execute("SELECT count(*) FROM t WHERE a > ?", [0])
    assert cursor.fetchone() == (0,)
    cursor.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?)", rows)
    connection.commit()
    connection.close()
    got = jdbc.read_query(spark, source, "SELECT * FROM t").orderBy("A").collect()
    assert tuple(got[0])[:3] == rows[0][:3] and got[0]["E"] == Decimal("1.50") and got[1]["B"] is None
    with pytest.raises(SourceError, match="reached"):
        jdbc.Connection(spark, Source("n", "jdbc", url="jdbc:nothing:here"))


def test_push(spark, project):
    c = Connection()
    w = Workspace(project / "plumbline.yaml", spark, extract=Extract(), connect=lambda source: c)
    with pytest.raises(PushRefused):
        w.push([{"a": 1}], "Prod.dbo.t")
    assert c.log == []
    assert w.push(spark.range(5).coalesce(1), "sand.DBO.t]x", batch_size=2) == 5
    assert "CREATE TABLE [sand].[DBO].[t]]x] ([id] BIGINT)" in c.log and [len(x[1]) for x in c.log if isinstance(x, tuple)] == [2, 2, 1] and c.log[-2:] == ["commit", "close"]
    for c2, how, kind in ((Connection(1), "fail", PlumbError), (Connection(fail=True), "fail", SourceError)):
        w._connect = lambda source, c2=c2: c2
        with pytest.raises(kind):
            w.push(spark.range(1), "Sand.dbo.t", how)
        assert c2.log[-2:] == ["rollback", "close"]
    c3 = Connection(1)
    w._connect = lambda source: c3
    w.push(spark.range(1), "Sand.dbo.t", "replace")
    assert any(str(x).startswith("DROP TABLE") for x in c3.log)


@pytest.mark.parametrize("kind, sql", [(T.ByteType(), "SMALLINT"), (T.IntegerType(), "INT"), (T.FloatType(), "REAL"), (T.DecimalType(9, 2), "DECIMAL(9,2)"), (T.StringType(), "NVARCHAR(MAX)"), (T.TimestampNTZType(), "DATETIME2"), (T.TimestampType(), "DATETIMEOFFSET"), (T.BinaryType(), "VARBINARY(MAX)"), (T.ArrayType(T.LongType()), None), (T.MapType(T.StringType(), T.LongType()), None)])
def test_push_types(kind, sql):
    f = T.StructField("x", kind)
    if sql:
        assert push.sql_type(f) == sql
    else:
        with pytest.raises(SourceError, match="'x'"):
            push.sql_type(f)


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name;n\nx;1\ny;2\n")
    df = csvfile.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["name", "n"] and [r["n"] for r in df.collect()] == [1, 2]
    (tmp_path / "b.csv").write_text("1,2\n3,4\n")
    assert csvfile.read_csv(spark, str(tmp_path / "b.csv")).count() == 2
    with pytest.raises(SourceError):
        csvfile.read_csv(spark, str(tmp_path / "none.csv"))


def workbook(path, sheets):
    """A small .xlsx file; datetimes get a date style."""
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    strings, parts = [], {}
    for k, rows in enumerate(sheets.values(), 1):
        body = ""
        for i, row in enumerate(rows, 1):
            cells = ""
            for j, v in enumerate(row):
                ref = f"{chr(65 + j)}{i}"
                if isinstance(v, str):
                    strings.append(v)
                    cells += f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>'
                elif isinstance(v, bool):
                    cells += f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
                elif isinstance(v, datetime):
                    cells += f'<c r="{ref}" s="1"><v>{(v - datetime(1899, 12, 30)).total_seconds() / 86400}</v></c>'
                elif v is not None:
                    cells += f'<c r="{ref}"><v>{v}</v></c>'
            body += f'<row r="{i}">{cells}</row>'
        parts[f"xl/worksheets/sheet{k}.xml"] = f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>"
    names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1))
    parts["xl/workbook.xml"] = f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>"
    parts["xl/sharedStrings.xml"] = f"<sst {ns}>" + "".join(f"<si><t>{esc(s)}</t></si>" for s in strings) + "</sst>"
    parts["xl/styles.xml"] = f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'
    with zipfile.ZipFile(path, "w") as z:
        for n, text in parts.items():
            z.writestr(n, text)


def test_xlsx(spark, tmp_path, project):
    path = tmp_path / "w.xlsx"
    workbook(path, {"Main": [["Report of May", None, None, None], [None] * 4, ["UR", "Referral Date", None, "Days"], ["a", datetime(2026, 5, 1), 1, "1,234"], ["b", datetime(2026, 5, 2), 2.5, 8]], "Notes": [["x", "x"], ["A", "B"], [True, 1]]})
    t = xlsx.read_sheet(path)
    assert t.to_pylist() == [{"UR": "a", "Referral Date": date(2026, 5, 1), "col_2": 1.0, "Days": "1,234"}, {"UR": "b", "Referral Date": date(2026, 5, 2), "col_2": 2.5, "Days": "8"}]
    assert xlsx.read_sheet(path, "Notes", header=[0, 1]).column_names == ["x A", "x B"]
    assert xlsx.read_sheet(path, 1, header=None, skip_rows=2).to_pylist() == [{"col_0": True, "col_1": 1.0}]
    assert xlsx.read_sheet(path, "Notes", header=(1, 0)).column_names == ["x A", "x B"]
    assert xlsx.column_names([["a", "a", None]], 3) == ["a", "a_2", "col_2"]
    assert xlsx.column_names([["g", None, "h", None], ["", "t", None, None], ["a", "b", "b", "b"]], 5) == ["g a", "g t b", "h t b", "h t b_2", "col_4"]
    assert xlsx.column_names([], 2) == ["col_0", "col_1"]
    for bad in ({"sheet": "No"}, {"sheet": 7}, {"header": 99}):
        with pytest.raises(SourceError):
            xlsx.read_sheet(path, **bad)
    with pytest.raises(SourceError):
        xlsx.read_sheet(tmp_path / "none.xlsx")
    w = Workspace(project / "plumbline.yaml", spark, extract=Extract())
    assert w.read_excel(path).count() == 2 and w.read_excel(path, land="sheet_of_may") == 2


def test_cleaners(spark):
    df = spark.createDataFrame([(" a ", None, "05/01/2026", "$1,234.50", 45658.0, "-"), ("", None, "bad", "N/A", 1.5, "2"), (None, None, None, None, None, None)], "`My Name!` string, `my name` string, `When?` string, amount string, serial double, ``` string".replace("```", "`%%`"))
    out = cleaners.clean(df, cleaners.snake_names, cleaners.drop_empty, cleaners.strip_strings, cleaners.parse_dates("when", format="%d/%m/%Y"), cleaners.parse_dates("serial"), cleaners.numeric("amount", "col"))
    assert out.columns == ["my_name", "when", "amount", "serial", "col"]
    assert [tuple(r) for r in out.collect()] == [("a", datetime(2026, 1, 5), 1234.5, datetime(2025, 1, 1), None), (None, None, None, datetime(1899, 12, 31, 12), 2.0)]
    assert cleaners.drop_empty(df.limit(0)).columns == df.columns
    with pytest.raises(PlumbError):
        cleaners.numeric("zz")(df)
    with pytest.raises(PlumbError):
        cleaners.spark_pattern("%Q")


def test_entry_queries_have_sql():
    import __spark_entry__ as e

    names = [n for n in e.queries() if not n.startswith("op") and n != "pipeline"]
    assert len(names) >= 50 and all(n in e.oracle_sql() for n in names)
