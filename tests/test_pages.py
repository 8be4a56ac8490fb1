"""The data source of positioned words, with decoders made up for the test."""

from docfacts.sources import pages


def test_documents_are_read_through_a_plugged_decoder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(b"%PDF one two")
    (tmp_path / "sub/b.pdf").write_bytes(b"%PDF ")
    (tmp_path / "c.pdf").write_bytes(b"plain")
    (tmp_path / "d.pdf").write_bytes(b"")
    (tmp_path / "e.txt").write_bytes(b"%PDF left out")
    code = tmp_path / "made_up_decoder.py"
    code.write_text("def words(content):\n    if content == b'%PDF ':\n        raise ValueError('broken')\n    return [(1, i, w.decode(), 1.0, 2.0, 3.0, 4.0, False) for i, w in enumerate(content.split()[1:])]\n")
    spark.sparkContext.addPyFile(str(code))
    pages.register(spark)
    rows = spark.read.format("document_words").option("decoder", "made_up_decoder:words").load(str(tmp_path)).collect()
    assert sorted((r["file"].rsplit("/", 1)[1], r["seq"] or 0, r["text"] or "", r["error"] or "") for r in rows) == [
        ("a.pdf", 0, "one", ""), ("a.pdf", 1, "two", ""), ("b.pdf", 0, "", "ValueError: broken"), ("c.pdf", 0, "", "not_pdf"), ("d.pdf", 0, "", "empty"),
    ]
