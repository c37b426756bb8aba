import datetime
import json

import pytest
from pyspark.sql import functions as F

from sargam.sources import readers
from sargam.streaming import state as streaming


def test_documents_and_directory(spark, tmp_path):
    schema = readers.CANDIDATES
    for name in ("a", "b", "_stamp"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"song_id": name, "candidates": [{"id": "x", "views": 1}]}))
    df = readers.read_directory(spark, str(tmp_path), schema)
    assert sorted(r["key"] for r in df.collect()) == ["a", "b"]
    assert readers.read_optional(spark, str(tmp_path / "none"), schema).count() == 0
    readers.write_table(df.drop("key"), str(tmp_path / "t"), ["song_id"])
    readers.write_table(df.drop("key").where("song_id = 'a'").withColumn("fetched", F.lit("now")), str(tmp_path / "t"), ["song_id"])
    back = {r["song_id"]: r["fetched"] for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert back == {"a": "now", "b": None}
    assert readers.restrict_to(df, "song_id", ["b"]).count() == 1
    readers.write_documents(df.select("song_id"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_markup(spark):
    html = '<a href="/x">X</a> <a href="/y">Y</a> <b>Taal</b>: Teora <b>Raag</b>: A <b>Raag</b>: B'
    row = spark.createDataFrame([(html,)], "h string").select(readers.index_links(F.col("h")).alias("l"), readers.page_fields(F.col("h")).alias("f")).first()
    assert [tuple(x) for x in row["l"]] == [("/x", "X"), ("/y", "Y")] and row["f"] == {"Taal": "Teora", "Raag": "B"}


def test_candidates_lines_audit_due(spark):
    body = json.dumps({"items": [{"id": "v", "snippet": {"title": "t"}, "contentDetails": {"duration": "PT2M"}, "statistics": {"viewCount": "12"}, "status": {"embeddable": True}}, {"id": "w"}]})
    got = [tuple(r) for r in readers.parsed_candidates(spark.createDataFrame([("s", body)], "song_id string, body string"), "body").collect()]
    assert got == [("s", "v", "t", "", 12, 0, 120, True), ("s", "w", "", "", 0, 0, 0, False)]
    pages = spark.createDataFrame([(2, "অমর। কথা এক\n\n১২\nরাজার প্রবেশ।\nঅমর ও কুমার। {{gap}}কথা দুই{{rule|4em}}কথা তিন। শেষ প্রস্থান নয়"), (1, "কথা শূন্য"), (9, "x"), (3, None), (7, "কথা সাত")], "n int, t string")
    got = [tuple(r) for r in readers.ordered_lines(pages, "n", "t", [(1, 3), (7, 8)]).select("page", "line").orderBy("page", "pos").collect()]
    assert got == [(1, "কথা শূন্য"), (2, "কথা এক"), (2, "কথা দুই"), (2, "কথা তিন। শেষ প্রস্থান নয়"), (7, "কথা সাত")]
    tables = readers.audit(spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "i int, decision string"))
    assert {k: t.count() for k, t in tables.items()} == {"x": 2, "y": 1}
    now = F.lit(datetime.datetime(2024, 3, 1))
    assert readers.due(spark.createDataFrame([(datetime.datetime(2024, 2, 1),)], "last timestamp"), "last", 28, now).first()["due"]
    assert not readers.due(spark.createDataFrame([(datetime.datetime(2024, 2, 20),)], "last timestamp"), "last", 28, now).first()["due"]
    assert readers.due(spark.createDataFrame([], "last timestamp"), "last", 28, now).first()["due"]
    df, observation = readers.with_metrics(spark.range(10), "m", even=F.col("id") % 2 == 0)
    df.write.format("noop").mode("overwrite").save()
    assert observation.get == {"rows": 10, "even": 5}


def test_streams(spark, tmp_path):
    schema = "user bigint, item string, at timestamp, version int"
    source = tmp_path / "in"
    for k in range(3):
        rows = [(u, f"i{k}{j}", datetime.datetime(2024, 1, 1 + k, 0, j), k) for u in (1, 2) for j in range(3)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = streaming.recent_lists(stream(), "user", "item", "at", most=4).writeStream.outputMode("update").format("memory").queryName("recent").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    lists = [r["recent"] for r in spark.table("recent").where("user = 1").collect()]
    assert max(map(len, lists)) == 4 and any(x[-3:] == ["i20", "i21", "i22"] for x in lists)
    streaming.resumable_upsert(stream(), str(tmp_path / "out"), "user", "version", str(tmp_path / "c2")).awaitTermination(120)
    assert sorted((r["user"], r["version"]) for r in streaming.latest_rows(spark.read.parquet(str(tmp_path / "out")), "user", "version").collect()) == [(1, 2), (2, 2)]
    counts = streaming.windowed_counts(stream(), "at", "user").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    counts.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 18


def test_parsed_pages(spark):
    pages = [
        ("<p><b>Taal</b> : <a href='x'>Teora &amp; Rupak</a></p><b>Raag:</b> A<br>rest<pre>one<br>two <i>three</i></pre><pre>four</pre>",), ("<b>a</b>: 1<b>a</b>: 2",), (None,), ("",), ("<b>open",), ("<!-- <b>x</b>: y --><script>'<b>q</b>: z'</script>",),
    ]
    got = [(r["p"]["fields"], r["p"]["text"]) for r in spark.createDataFrame(pages, "h string").select(readers.parsed_page("h").alias("p")).collect()]
    assert got == [({"Taal": "Teora & Rupak", "Raag": "A"}, "one\ntwo three\nfour"), ({"a": "2"}, None), ({}, None), ({}, None), ({}, None), ({}, None)]


def test_published_tables_and_audits(spark, tmp_path):
    df = spark.createDataFrame([(k, None if k % 2 else "x") for k in range(10)], "i int, s string")
    readers.write_published(df, f"{tmp_path}/p", {"kind": "k"})
    assert readers.read_document(spark, f"{tmp_path}/p/meta", readers.schema(count="bigint", kind="string"), lines=True).first().asDict() == {"count": 10, "kind": "k"}
    assert readers.read_document(spark, f"{tmp_path}/p/rows", df.schema, lines=True).exceptAll(df).count() == 0
    with pytest.raises(ValueError):
        readers.audit(df.withColumn("decision", F.col("i").cast("string")), most=5)
