import os

import pytest
from pyspark.sql import functions as F

from quillveil.functions import text as X
from quillveil.sources import archives as A, docx


@pytest.fixture
def known(spark):
    A.register(spark)
    return spark


def documents(spark, n, parts=3):
    rows = spark.range(0, n, 1, parts).select(F.col("id").alias("doc_id"), F.create_map(F.lit(docx.DOCUMENT), F.encode(F.concat(F.lit("<w:t>text "), F.col("id").cast("string"), F.lit("</w:t>")), "UTF-8"), F.lit("word/media/image1.png"), F.unhex(F.lit("00ff")), F.lit("docProps/core.xml"), F.encode(F.lit("<x/>"), "UTF-8")).alias("parts"))
    return docx.written(rows).select(X.output_name(F.concat(F.lit("doc."), F.col("doc_id").cast("string"), F.lit(".docx"))).alias("name"), "content")


def test_written_and_read_again(known, tmp_path):
    path = str(tmp_path / "out")
    documents(known, 7).write.format("document_files").mode("append").save(path)
    assert sorted(f for f in os.listdir(path) if f[0] not in "._") == [f"doc.{i}-REDACTED.docx" for i in range(7)]
    assert open(f"{path}/_SUCCESS").read().startswith("7 files") and not [f for f in os.listdir(path) if f.startswith(("_pending", "_manifests"))]
    rows = known.read.format("word_archives").option("entries", "word/document.xml,docProps/*").load(path)
    got = sorted((r.name, r.error, sorted(r.parts), docx_text(known, r)) for r in rows.collect())
    assert got == [(f"doc.{i}-REDACTED.docx", None, ["docProps/core.xml", docx.DOCUMENT], f"<w:t>text {i}</w:t>") for i in range(7)]
    assert {len(r.parts) for r in known.read.format("word_archives").load(path).collect()} == {3}
    (tmp_path / "out" / "bad.docx").write_bytes(b"no archive")
    (tmp_path / "out" / "other.txt").write_bytes(b"x")
    (bad,) = known.read.format("word_archives").load(path).where("error IS NOT NULL").collect()
    assert bad.name == "bad.docx" and bad.parts == {}
    empty = tmp_path / "none"
    empty.mkdir()
    assert known.read.format("word_archives").load(str(empty)).collect() == []


def docx_text(spark, row):
    return bytes(row.parts[docx.DOCUMENT]).decode()


def test_conditions_on_names_open_no_other_files(known, tmp_path):
    path = str(tmp_path / "out")
    documents(known, 5).write.format("document_files").mode("append").save(path)
    rows = known.read.format("word_archives").load(path).where("name = 'doc.3-REDACTED.docx' AND size > 0")
    assert [r.name for r in rows.collect()] == ["doc.3-REDACTED.docx"]
    reader = A.ArchiveReader({"path": path})
    left = list(reader.pushFilters([A.StringEndsWith(("name",), "2-REDACTED.docx"), A.EqualTo(("size",), 3)]))
    assert len(left) == 1 and [len(p.files) for p in reader.partitions()] == [1]


def test_a_job_that_fails_leaves_nothing(known, tmp_path):
    path = str(tmp_path / "out")
    good = documents(known, 6)
    for bad in (F.when(F.col("name").contains("4"), F.lit("../x")).otherwise(F.col("name")), F.lit("same.docx")):
        with pytest.raises(Exception):
            good.select(bad.alias("name"), "content").coalesce(2).write.format("document_files").mode("append").save(path)
        assert not [f for f in os.listdir(path) if f != "."]
    good.write.format("document_files").mode("append").save(path)
    with pytest.raises(Exception, match="FileExistsError"):
        good.where("name like '%5%'").write.format("document_files").mode("append").save(path)
    good.where("name like '%5%'").write.format("document_files").mode("overwrite").save(path)
    assert len([f for f in os.listdir(path) if f.endswith(".docx")]) == 6
