"""Readers and writers on small files."""

from pyspark.sql import functions as F

from meshwork.sources import readers, writers
from meshwork.streaming import degrees


def test_text_readers(spark, tmp_path):
    p = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    t = p("t.tsv", "http://x/a\tr1\thttp://x/b\nbad\nhttp://x/a\tr/2\thttp://x/b\n")
    assert readers.bad_rows(spark, t, 3) == 1
    one = readers.dictionary(spark, p("d.tsv", "http://x/a\tcls\nhttp://x/a\tclass\n"))
    got = readers.rdf_graph(spark, t, one, one).collect()
    assert [(r.type, r.name, r.src_class, r.dst_class) for r in got] == [("r/2", "2", "class", None)]
    assert [r.edge for r in readers.edge_triples(spark, p("e.tsv", "a\tb\tr\n")).collect()] == ["EDGE_r"]
    nt = p("x.nt", '<s> <p> <o> .\n<s> <q> "li\\"t"@en .\n# no\n')
    assert sorted(r.dst for r in readers.n_triples(spark, nt).collect()) == ['li\\"t', "o"]
    m = readers.metapaths(spark, p("m.csv", "id,a,b,c\nC1,dr, ta,0\n")).first()
    assert m.types == ["dr", "ta"]
    a = readers.analogies(spark, p("a.txt", ": one\na b c d\n: two\ne f g h\n")).collect()
    assert [(r.section, r.expected) for r in a] == [("one", "d"), ("two", "h")]
    assert readers.settings(p("c.txt", "epochs 400\nrate 0.1\n")) == {"epochs": "400", "rate": "0.1"}
    k = readers.karate_matrix(spark, p("k.txt", "0 1\n1 0\n0 3\n3 0\n"), n=2)
    assert sorted(map(tuple, k.collect())) == [("0", "3", "1", 1.0), ("1", "3", "0", 1.0)]
    assert readers.random_graph(spark, 30, 40).count() == 40
    lab = readers.node_labels(spark, p("l.txt", "0\tB\n1\tA\n2\tB\n")).collect()
    assert {r.id: r.cluster for r in lab} == {"0": 1, "1": 0, "2": 1}
    assert readers.walks(spark, p("w.txt", "a b c\nd e\n")).where("walk_id = 1").first().tokens == ["d", "e"]


def test_writers(spark, tmp_path):
    v = spark.createDataFrame([("b", [1.0, 0.5]), ("a", [2.0, 0.25]), ("c", [0.0, 1.0])], "id string, vector array<double>")
    writers.embeddings_tsv(v.coalesce(1), str(tmp_path / "e"), str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "e")).collect()][0] == "2.000000\t0.250000"
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ["a", "b", "c"]
    writers.walks_text(spark.createDataFrame([(1, ["x", "y"])], "walk_id int, tokens array<string>"), str(tmp_path / "w"))
    assert spark.read.text(str(tmp_path / "w")).first().value == "x y"
    writers.ranking_csv(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, score double"), "score", str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).first().id == "b"
    assert writers.coordinates(v).count() == 3


def test_windowed_stream(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a"), ("2024-01-01 03:00:00", "b")]
    df = spark.createDataFrame(rows, "ts string, event_type string").select(F.to_timestamp("ts").alias("ts"), "event_type")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = degrees.windowed_counts(stream).writeStream.outputMode("append").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.event_type, r.n) for r in spark.table("counts").collect()] == [("a", 2)]
