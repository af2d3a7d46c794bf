from pyspark.sql import functions as F

from scriptoria.operators import people
from scriptoria.sources import files, markup
from scriptoria.streaming import counts

XML = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body>
<div type="essay" xml:id="d1"><head> Un
 título </head><byline>Por <persName ref="#ana #x">Ana</persName></byline>
<p xml:id="p1" ana="#uno  #dos">Dice <persName ref="#kafka #joyce">ellos</persName> en
 <placeName ref="#roma">Roma</placeName>.<note resp="#ED">ver <persName ref="#oculto">X</persName></note></p>
<div><p>Sin id <persName>nadie</persName></p></div></div>
<div><div><p>huérfano de tipo</p><closer><signed>Por Luis  Pérez</signed></closer></div></div>
<p>suelto</p><note resp="#A">fuera</note></body></text>
<interpGrp><interp xml:id="c1"> la  firma </interp><interp>sin</interp></interpGrp>
<listPerson><person xml:id="k"><persName><forename>Franz</forename><forename type="given">F.</forename><surname>Kafka</surname></persName><birth><date when="1883-07-03"/><placeName ref="#praga"/></birth><idno subtype="wikidata">Q905</idno></person>
<person xml:id="h"><persName>Homero  de Quíos</persName><birth><date when="-0750"/></birth></person><person><persName>sin id</persName></person></listPerson>
<listPlace><place xml:id="praga"><location><country>Praga</country></location></place><place xml:id="nada"/></listPlace></TEI>"""


def docs(spark, *more):
    return spark.createDataFrame([("/x/n1.xml", "n1", XML), ("/x/n2.xml", "n2", None), *more], "path string, name string, content string")


def test_paragraphs(spark):
    got = markup.extracted(docs(spark), markup.paragraph_rows).orderBy("place").collect()
    p = got[0]
    assert (p["para_id"], p["issue"], p["div_id"], p["div_type"], p["text_id"], p["contributor"], p["has_note"]) == ("p1", "n1", "d1", "essay", "d1", "ana", True)
    assert p["text"] == "Dice ellos en Roma.ver X" and p["persons"] == ["kafka", "joyce"] and p["places"] == ["roma"] and p["ana_gold"] == ["uno", "dos"]
    assert (got[1]["text_id"], got[1]["div_type"], got[1]["contributor"], got[1]["persons"]) == ("d1", "essay", "ana", [])
    assert (got[2]["text_id"], got[2]["div_type"], got[2]["contributor"]) == ("n1_pos7", None, "luis pérez")
    assert (got[3]["text_id"], got[3]["contributor"]) == ("n1_orphan", None) and len(got) == 4


def test_other_rows(spark, rows):
    assert rows(markup.extracted(docs(spark), markup.concept_rows)) == [("c1", "la firma")]
    assert tuple(markup.note_counts(markup.extracted(docs(spark), markup.note_rows)).first()) == (2, 1, 1, 1)
    titles = rows(markup.extracted(docs(spark), markup.title_rows))
    assert ("d1", "Un título") in titles and ("n1_pos7", "") in titles
    persons, places = markup.extracted(docs(spark), markup.person_rows), markup.extracted(docs(spark), markup.place_rows)
    assert rows(people.prosopography(persons, places)) == [("h", "Homero de Quíos", -750, None, None, "Other/Unknown", "Antiquity (Archaic)", None), ("k", "F. Kafka", 1883, None, "Czech Republic", "Eastern Europe", "Long 19th Century", "Q905")]


def test_files(spark, rows, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.xml").write_text(XML)
    assert markup.documents(spark, str(tmp_path)).select("name").collect()[0][0] == "a"
    inc = tmp_path / "x" / "b.xml"
    inc.write_text('<TEI xmlns="http://www.tei-c.org/ns/1.0" xmlns:xi="http://www.w3.org/2001/XInclude"><xi:include href="part.inc"/></TEI>')
    (tmp_path / "x" / "part.inc").write_text('<p xmlns="http://www.tei-c.org/ns/1.0">incluido</p>')
    assert [p["text"] for p in markup.paragraph_rows("b", inc.read_text(), f"file:{inc}")] == ["incluido"]
    (tmp_path / "1987").mkdir()
    (tmp_path / "1987" / "n.txt").write_bytes(b"a\xffb")
    assert rows(files.texts(spark, str(tmp_path))) == [("n", "1987", "a�b")]
    (tmp_path / "t.csv").write_bytes('﻿lemma,n\nnan,1\n"a\nb",2\n'.encode())
    assert rows(files.csv(spark, str(tmp_path / "t.csv"))) == [("a\nb", "2"), ("nan", "1")]
    assert rows(files.csv(spark, str(tmp_path / "t.csv"), keep_na=False)) == [(None, "1"), ("a\nb", "2")]
    (tmp_path / "w.txt").write_text("# nota\n\nde la  DE\n3x que\n")
    assert rows(files.stop_words(spark, str(tmp_path / "w.txt"))) == [("de",), ("la",), ("que",)]
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, t string")
    files.write_manifest(files.fingerprint(df, "k", "t"), str(tmp_path / "m"))
    m = files.settings(spark, str(tmp_path / "m"))
    assert files.is_current(df.repartition(3), "k", "t", m) and not files.is_current(df.withColumn("t", F.coalesce("t", F.lit(""))), "k", "t", m)
    files.write_csv(df, str(tmp_path / "o"))
    files.write_parquet(df, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 2


def test_stream_equals_batch(spark, rows, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "b", 4.0)], "ts string, k string, v double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev"))
    q = counts.tumbling(stream, "ts", "k", "v").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("windows")) == rows(counts.tumbling(df, "ts", "k", "v")) and len(rows(spark.table("windows"))) == 2


def test_rows_of_many_documents_are_given_on_together(spark, monkeypatch):
    monkeypatch.setattr(markup, "BATCH", 7)
    many = spark.range(50).select(F.lit("").alias("path"), F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") % 10 != 9, F.concat(F.lit("<TEI xmlns='http://www.tei-c.org/ns/1.0'><p>a "), "id", F.lit("</p><p/></TEI>"))).alias("content"))
    got = markup.extracted(many, markup.paragraph_rows)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()  # not a pandas frame per document
    want = {(f"n{k}", place, f"a {k}" if place == 0 else "") for k in range(50) if k % 10 != 9 for place in (0, 1)}
    assert {(r["issue"], r["place"], r["text"]) for r in got.collect()} == want and got.count() == 90
