"""Sources on small inline fixtures, and resumable tagging."""

import json
import os
import tempfile

from handprint.sources import files, tei
from handprint.streaming import resume

TEI = """<?xml version="1.0" encoding="UTF-8"?>
<TEI xmlns="http://www.tei-c.org/ns/1.0">
  <teiHeader><fileDesc><titleStmt>
    <title>De Via</title><author>Auctor Primus</author><author>Auctor Secundus</author>
  </titleStmt></fileDesc></teiHeader>
  <text><body>
    <div type="fragment"><head>Caput</head><p><label>1</label>Ibat   puer
    per viam<note>nota</note> et canebat.</p></div>
  </body></text>
</TEI>"""

VERSE = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt>
<title>Carmen</title><author>Poeta</author></titleStmt></fileDesc></teiHeader>
<text><body><lg><l>arma virumque cano</l></lg></body></text></TEI>"""


def _folder(contents: dict) -> str:
    d = tempfile.mkdtemp(prefix="hp-test-")
    for name, text in contents.items():
        with open(os.path.join(d, name), "w", encoding="utf-8") as f:
            f.write(text)
    return d


def test_read_tei(spark):
    d = _folder({"AB1-DeVia-Longa.xml": TEI, "PC9-Carmen.xml": VERSE})
    df = tei.read_tei(spark, d + "/*.xml")
    rows = {r.stem: r for r in tei.name_columns(df).collect()}
    r = rows["AB1-DeVia-Longa"]
    assert r.title == "De Via" and r.authors == ["Auctor Primus", "Auctor Secundus"]
    assert "1" not in r.text.split() and "Ibat puer per viam" in r.text
    assert r.has_fragment and not r.is_poetry
    assert r.file_author == "AB1" and r.file_title == "DeVia" and r.textgroup == "AB1-DeV"
    assert rows["PC9-Carmen"].is_poetry
    three = tei.read_tei(spark, d + "/AB1*.xml", exclude=("label", "note", "head")).first()
    assert "nota" not in three.text and "Caput" not in three.text
    assert tei.one_row_per_author(df).count() == 3


def test_tagged_and_vocab(spark):
    d = _folder({"doc-tagged.txt": "Arma\tn-s---\n,\tu--\nvirumque v\n\n"})
    t = files.read_tagged(spark, d + "/*.txt").orderBy("pos").collect()
    assert [(r.token, r.tag) for r in t] == [("arma", "n"), (",", "u"), ("virumque", "v")]
    v = _folder({"mfw.json": json.dumps([["et", 10], ["'", 9], ["in", 8], ["est", 7]])})
    got = files.read_ranked_json(spark, v + "/mfw.json", 2).collect()
    assert [(r.rank, r.term, r.n) for r in got] == [(1, "et", 10), (2, "in", 8)]


def test_stopword_json(spark):
    sw = {"articles": ["ho", "he"], "particles": {"a": ["men", "de"], "b": {"c": ["gar"]}},
          "other": ["x"]}
    d = _folder({"sw.json": json.dumps(sw)})
    got = sorted(r.word for r in files.read_stopword_json(spark, d + "/sw.json",
                                                          ["articles", "particles"]).collect())
    assert got == ["de", "gar", "he", "ho", "men"]


def test_resume_batch(spark):
    out = tempfile.mkdtemp(prefix="hp-tags-") + "/tags"
    docs = spark.createDataFrame([(1, "The cat sat."), (2, "A dog ran quickly.")],
                                 "doc_id long, text string")
    assert resume.tag_new_documents(spark, docs, out) == 2
    more = docs.unionByName(spark.createDataFrame([(3, "Running now")], "doc_id long, text string"))
    assert resume.tag_new_documents(spark, more, out) == 1
    tags = spark.read.parquet(out)
    assert tags.select("doc_id").distinct().count() == 3
    assert {r.tag for r in tags.filter("token = '.'").collect()} == {"u"}


def test_resume_stream(spark):
    src = _folder({"d1.txt": "The cat sat.", "d2.txt": "A dog ran."})
    base = tempfile.mkdtemp(prefix="hp-stream-")
    q = resume.tag_stream(spark, src, base + "/out", base + "/ckpt")
    q.awaitTermination()
    assert spark.read.parquet(base + "/out").select("doc").distinct().count() == 2
    with open(os.path.join(src, "d3.txt"), "w") as f:
        f.write("Birds fly.")
    q = resume.tag_stream(spark, src, base + "/out", base + "/ckpt")
    q.awaitTermination()
    out = spark.read.parquet(base + "/out")
    assert out.select("doc").distinct().count() == 3
    assert out.filter("doc = 'd1'").count() == 4  # not tagged twice
