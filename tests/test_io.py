"""Sources, sinks, integrity and streams."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from panelforge.operators.panel import numbered
from panelforge.sources import integrity, readers, sinks
from panelforge.streaming import events

SF = "/root/testdata/sf0.001"


def test_zip_csv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("data.csv", "mo;period;value;extra\nx;2023-01-01;1.5;q\ny;2023-02-01;;q\n")
    got = readers.zip_csv(spark, f"file://{tmp_path}/a.zip", "mo string, value double, period date").orderBy("mo").collect()
    assert [(r.mo, r.value, str(r.period)) for r in got] == [("x", 1.5, "2023-01-01"), ("y", None, "2023-02-01")]
    with pytest.raises(Exception, match="missing columns"):
        readers.zip_csv(spark, f"file://{tmp_path}/a.zip", "absent string").collect()
    with pytest.raises(ValueError):
        readers.single_member(["a.csv", "b.csv"])
    assert readers.single_member(["a.csv", "d/b.csv"], root_only=True) == "a.csv"


def test_wide_labels(spark, tmp_path):
    (tmp_path / "l.csv").write_text("mo,2023-01,2023-02\na,1,2\nb,3,4\n")
    labels = readers.wide_labels(spark, f"file://{tmp_path}/l.csv", "mo")
    assert labels.count() == 4
    units = numbered(labels, "mo")
    assert [(r.idx, r.mo, r.label) for r in readers.last_labels(labels, units, "mo").orderBy("idx").collect()] == [(0, "a", 2), (1, "b", 4)]
    with pytest.raises(Exception, match="missing or repeated"):
        readers.last_labels(labels, units.union(spark.createDataFrame([("c", 2)], "mo string, idx bigint")), "mo").collect()


def test_renamed_and_delimited(spark, tmp_path):
    (tmp_path / "x.csv").write_text("old;n\na;1\n")
    x = readers.delimited(spark, f"file://{tmp_path}/x.csv", "old string, n int", sep=";")
    assert readers.renamed(x, {"old": "new"}, ["new", "n"]).columns == ["new", "n"]
    with pytest.raises(ValueError):
        readers.renamed(x, {}, ["new"])


def test_staged_filter(spark):
    kept, counts = readers.staged_filter(spark.range(100), [("even", F.col("id") % 2 == 0), ("small", F.col("id") < 10)])
    assert kept.count() == 5 and tuple(counts.first()) == (100, 50, 5)


def test_sinks(spark, tmp_path):
    x = spark.createDataFrame([(2, 0.1, None), (1, float("nan"), "é")], "k int, v double, s string")
    sinks.sorted_csv(x, f"file://{tmp_path}/out", ["k"])
    with pytest.raises(Exception, match="exist"):
        sinks.sorted_csv(x, f"file://{tmp_path}/out", ["k"])
    assert [json.loads(r.json) for r in sinks.records(x).orderBy("json").collect()] == [{"k": 1, "v": None, "s": "é"}, {"k": 2, "v": 0.1, "s": None}]
    digest = sinks.write_json(f"{tmp_path}/a.json", {"b": [float("nan"), 1], "a": "é"})
    assert integrity.file_digest(f"{tmp_path}/a.json") == digest and json.loads((tmp_path / "a.json").read_text()) == {"a": "é", "b": [None, 1]}
    assert sinks.markdown([{"a": 1.0, "b": None}], ["a", "b"], 2) == "| a | b |\n|---|---|\n| 1.00 |  |\n"
    assert sinks.html_report("<b>{{x}}</b>", {"x": "<"}) == "<b>&lt;</b>"
    with pytest.raises(ValueError):
        sinks.html_report("{{y}}", {})


def test_resumable(spark, tmp_path):
    base = f"file://{tmp_path}/runs"
    job = lambda k: spark.range(k)
    assert sinks.resumable(spark, base, [1, 2], job, "c1") == [1, 2]
    assert sinks.resumable(spark, base, [1, 2, 3], job, "c1") == [3]
    with pytest.raises(ValueError):
        sinks.resumable(spark, base, [1], job, "c2")


def test_inventory_and_constraints(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a")
    inv = readers.inventory(spark, f"file://{tmp_path}/*.txt")
    assert inv.first().sha256 == integrity.file_digest(f"{tmp_path}/a.txt")
    changed = integrity.inventory_differences(inv, inv.withColumn("sha256", F.lit("0"))).first()
    assert changed.problem == "changed"
    x = spark.range(10)
    assert {r.rule: r.failing for r in integrity.constraints(x, {"low": "id < 8", "any": "id >= 0"}).collect()} == {"low": 2, "any": 0}
    with pytest.raises(Exception, match="too large"):
        integrity.require(x, "id < 8", "too large").collect()


def test_configuration(tmp_path):
    (tmp_path / "base.json").write_text('{"a": {"x": 1, "y": 2}, "l": [1]}')
    (tmp_path / "own.json").write_text('{"extends": "base.json", "a": {"y": 3}, "l": [2]}')
    assert integrity.load_config(f"{tmp_path}/own.json") == {"a": {"x": 1, "y": 3}, "l": [2]}
    (tmp_path / "loop.json").write_text('{"extends": "loop.json"}')
    with pytest.raises(ValueError):
        integrity.load_config(f"{tmp_path}/loop.json")
    with pytest.raises(ValueError):
        integrity.contained(str(tmp_path), "../other")
    assert integrity.digest({"b": 1, "a": 2}) == integrity.digest({"a": 2, "b": 1})
    assert "pyspark" in integrity.manifest({})


def test_streams_equal_batches(spark, tmp_path):
    """A stream over the whole table, ended by later rows that close every window, gives the batch result."""
    table = spark.read.parquet(f"{SF}/events.parquet")
    last = table.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.expr("ts + interval 30 days"))
    (tmp_path / "in").mkdir()
    table.coalesce(1).write.parquet(f"file://{tmp_path}/in/a")
    path = tmp_path / "flat"
    path.mkdir()
    for k, df in enumerate((table, last, last.withColumn("ts", F.expr("ts + interval 1 day")))):
        df.coalesce(1).write.parquet(f"file://{tmp_path}/w{k}")
        part = next((tmp_path / f"w{k}").glob("*.parquet"))
        part.rename(path / f"{k}.parquet")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{path}")
    q = events.tumbling(stream).writeStream.format("memory").queryName("tumbled").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    form = lambda df: sorted((str(r.start), r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert form(spark.table("tumbled")) == form(events.tumbling(table))


def test_switch_state(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet")
    table.repartition(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"file://{tmp_path}/in")
    q = events.switch_stream(stream).writeStream.format("memory").queryName("switched").outputMode("update").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.user_id: (r.events, r.switches) for r in spark.table("switched").collect()}
    want = table.selectExpr("user_id", "event_type <> lag(event_type) over (partition by user_id order by ts, event_id) as s").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("s").alias("s"))
    assert got == {r.user_id: (r.n, r.s) for r in want.collect()}


def test_matrix_files(spark, tmp_path):
    import numpy as np

    from panelforge.sources import matrices

    m = np.arange(12.0).reshape(4, 3)
    matrices.write_matrices(str(tmp_path / "m.npy"), m=m)
    matrices.write_matrices(str(tmp_path / "m.npz"), m=m, other=m + 1)
    got = sorted((r.row, r["values"]) for r in matrices.npy_rows(spark, f"file://{tmp_path}/m.npy").collect())
    assert got == [(k, m[k].tolist()) for k in range(4)]
    assert matrices.npz_slice_mean(spark, f"file://{tmp_path}/m.npz", "other", [0, 2], [1, 2]).first() == (float((m + 1)[np.ix_([0, 2], [1, 2])].mean()), 4)
    matrices.write_matrices(str(tmp_path / "labels.npy"), x=np.array([1, 2, 3, 4, 5, 6], np.int32))
    assert sorted(tuple(r) for r in matrices.npy_last_labels(spark, f"file://{tmp_path}/labels.npy", 2, 3).collect()) == [(0, 4), (1, 5), (2, 6)]
    with pytest.raises(Exception, match="reshape"):
        matrices.npy_last_labels(spark, f"file://{tmp_path}/labels.npy", 2, 4).collect()


def test_workbook_keeps_codes(spark, tmp_path):
    import zipfile

    from panelforge.sources import matrices

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>code</t></si><si><t>name</t></si><si><t>007</t></si><si><r><t>Аб</t></r><r><t>в</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="C2" t="s"><v>3</v></c></row>'
                   '<row><c r="A3" t="inlineStr"><is><t>01-2</t></is></c></row><row><c r="C4"><v>5</v></c></row></sheetData></worksheet>')
    got = [tuple(r) for r in matrices.workbook(spark, f"file://{tmp_path}/d.xlsx", ["name", "code"]).collect()]
    assert got == [("Абв", "007"), (None, "01-2"), ("5", None)]
    with pytest.raises(Exception, match="missing columns"):
        matrices.workbook(spark, f"file://{tmp_path}/d.xlsx", ["region"]).collect()


def test_graph_bundle_and_adjacency(spark, tmp_path):
    from panelforge.sources import matrices

    edges = spark.createDataFrame([(1, 2, 0.5), (2, 3, 1.0), (3, 3, 2.0)], "src bigint, dst bigint, weight double")
    nodes = spark.range(1, 4).withColumnRenamed("id", "node")
    mark = matrices.write_graph(nodes, edges, f"file://{tmp_path}/g")
    assert sorted(matrices.read_graph(spark, f"file://{tmp_path}/g", mark)[1].collect()) == sorted(edges.collect())
    with pytest.raises(ValueError, match="digest"):
        matrices.read_graph(spark, f"file://{tmp_path}/g", "other")
    edges.limit(1).write.mode("overwrite").parquet(f"file://{tmp_path}/g/edges")
    with pytest.raises(ValueError, match="digest"):
        matrices.read_graph(spark, f"file://{tmp_path}/g")
    assert sorted(matrices.from_adjacency(matrices.to_adjacency(edges)).collect()) == sorted(edges.collect())


def test_command_line_runs_and_verifies(spark, tmp_path, capsys):
    from panelforge import __main__ as cli

    out = str(tmp_path)
    assert cli.main(["run", "group_size", "--data", SF, "--out", out]) == 0
    assert cli.main(["verify", out]) == 0
    with pytest.raises(FileExistsError):
        cli.run(spark, SF, out, ["group_size"])
    cli.run(spark, SF, out, ["group_size"], force=True)
    spark.range(3).write.mode("overwrite").parquet(f"file://{out}/group_size/table")
    assert cli.verify(spark, out) == ["group_size"]
    assert cli.main(["inspect", "nation", "--data", SF]) == 0 and "n_nationkey" in capsys.readouterr().out
    with pytest.raises(ValueError, match="unknown"):
        cli.run(spark, SF, out, ["nothing"])
