import json
from datetime import date

from pyspark.sql import functions as F

from codexloom.operators.asknown import change_log
from codexloom.sources import html, store
from codexloom.streaming import deliveries

BOLD = '<div><font style="font-weight:bold">{}</font></div>'
PAGE = (
    "<html><!-- saved from url=(0040)https://x.example/a.htm -->\n<table><tr><td>7.05 Contents</td></tr></table><div>dated as of May 6, 2019</div><div>ACME, INC., as Borrower</div>"
    + BOLD.format("ARTICLE VII Covenants") + BOLD.format("7.05 Dispositions. No sale:") + "<div>(a)&nbsp;first</div><div>(d) stays</div><div>(b) second</div><table><tr><td>grid</td><td>1</td></tr></table>"
    + BOLD.format("1.01 Defined Terms. As used:") + "<div>(a) not split</div>"
)


def test_machine_html():
    s = {x["id"]: x for x in html.machine_sections(PAGE, "base")}
    assert list(s) == ["base::preamble", "base::art7", "base::7.05", "base::7.05(a)", "base::7.05(b)", "base::1.01"]
    assert s["base::7.05(a)"]["text"] == "(a) first\n(d) stays" and s["base::7.05(b)"]["text"] == "(b) second\ngrid 1"
    assert s["base::1.01"]["text"].endswith("(a) not split") and s["base::7.05"]["title"] == "Dispositions"


def test_machine_definitions():
    term = '<div><font style="text-decoration: underline">“{0}”</font> means {0} things.</div>'
    page = BOLD.format("ARTICLE I Terms") + term.format("Early") + BOLD.format("1.01 Defined Terms.") + "<div>As used:</div>" + term.format("Base Rate") + "<div>(a) more</div>" + "<div>“Plain” means nothing.</div>" + term.format("Loan") + BOLD.format("1.02 Other.") + term.format("Late")
    got = html.machine_definitions(page, "base")
    assert [d["term"] for d in got] == ["Base Rate", "Loan"]
    assert got[0]["text"] == "“Base Rate” means Base Rate things.\n(a) more\n“Plain” means nothing." and got[0]["id"] == "base::def::Base Rate"


def test_folder_of_filings(spark, tmp_path):
    text = "FIRST AMENDMENT TO it dated as of June 1, 2020. 1.1 Alpha. See Section 7.05 Beta. 1.2 Gamma. 5.1 Skips. 2.1 Next. " + "word " * 1200 + "1.11 Amendment to Section 2. Text. 1.3 Delta."
    (tmp_path / "b.htm").write_bytes(f'<font style="color:white">{text}</font>'.encode("windows-1252"))
    (tmp_path / "a.html").write_bytes(PAGE.encode("windows-1252"))
    (tmp_path / "c.htm").write_bytes(b"<div>\x81 no heading, dated as of Smarch 45, 2020</div>")
    docs = {r.path.rsplit("/", 1)[-1]: r for r in html.read_documents(spark, str(tmp_path)).collect()}
    assert (docs["b.htm"].id, docs["b.htm"].scanned, docs["b.htm"].amendment_number, docs["b.htm"].doc_date) == ("amendment_1", True, 1, date(2020, 6, 1))
    a = docs["a.html"]
    assert (a.id, a.doc_type, a.amendment_number, a.doc_date, a.filing_url, a.scanned) == ("base", "base", None, date(2019, 5, 6), "https://x.example/a.htm", False)
    assert docs["c.htm"].doc_date is None and docs["c.htm"].filing_url == ""
    rows = html.read_sections(spark, str(tmp_path))
    got = rows.where("document_id = 'amendment_1'").orderBy("pos").collect()
    assert [r.number for r in got] == ["0", "1.1", "1.2", "2.1", "1.11"] and [r.id for r in got][:2] == ["amendment_1::preamble", "amendment_1::1.1"]
    assert got[0].title == "PREAMBLE" and got[1].text == "1.1 Alpha. See Section 7.05 Beta." and got[1].title == "" or got[1].title.startswith("1 Alpha")
    assert got[4].title.startswith("Amendment to Section 2") and rows.where("document_id = 'base'").count() >= 6
    assert html.read_definitions(spark, str(tmp_path)).count() == 0


def test_graph_round_trip(spark, tmp_path):
    v = spark.createDataFrame([("a", "Section")], "id string, node_type string")
    e = spark.createDataFrame([("a", "b", "REFERENCES", "REFERENCES", 1)], "src string, dst string, edge_key string, edge_type string, seq int")
    store.save_graph(v, e, str(tmp_path / "g"))
    v2, e2 = store.load_graph(spark, str(tmp_path / "g"))
    assert v2.collect() == v.collect() and [tuple(r) for r in e2.select(*e.columns).collect()] == [tuple(r) for r in e.collect()]
    (tmp_path / "n.json").write_text(json.dumps({"nodes": [{"id": "x"}], "links": [{"source": "x", "target": "y", "key": "AMENDS::1.1"}]}))
    assert store.load_node_link(spark, str(tmp_path / "n.json"))[1].first().edge_type == "AMENDS"


def test_resumable_results(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z")], "k int, v string")
    assert {tuple(r) for r in store.last_wins([a, b], ["k"]).collect()} == {(1, "x"), (2, "z")}
    assert [r.k for r in store.unfinished(a, b, ["k"]).collect()] == [1]


def test_streams(spark, sf, tmp_path):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    src = tmp_path / "ev"
    ev.unionByName(ev.limit(50)).write.parquet(str(src))
    stream = spark.readStream.schema(ev.schema).parquet(str(src))

    def run(df, mode):
        q = df.writeStream.outputMode(mode).format("memory").queryName(f"t{mode}{len(df.columns)}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(f"t{mode}{len(df.columns)}")

    assert run(deliveries.once(stream, ["event_id"], "ts", "60 days"), "append").count() == ev.select("event_id").distinct().count()
    got = run(deliveries.counts(stream, "ts", ["event_type"], "1 day"), "complete")
    assert got.agg(F.sum("n")).first()[0] == ev.count() + 50
    assert run(deliveries.sessions(stream, "ts", ["user_id"], "30 minutes"), "complete").count() > 0


def test_streamed_change_log(spark, sf, tmp_path):
    v = spark.read.parquet(f"{sf}/effective.parquet")
    v.write.parquet(str(tmp_path / "v"))
    q = deliveries.keep_change_log(spark.readStream.schema(v.schema).parquet(str(tmp_path / "v")), str(tmp_path / "log"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "log")).groupBy("node_id", "day").agg(F.max("state").alias("state"))
    assert {tuple(r) for r in got.collect()} == {(r.node_id, r.day, r.state) for r in change_log(v).collect()}
