from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from shelfmark.operators import members
from shelfmark.sources import archives, checksums, plans, reports
from shelfmark.streaming import inventory


def make_zip(names, corrupt=False):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as out:
        for name, data in names:
            out.writestr(name, data)
    content = buffer.getvalue()
    return content.replace(b"PAYLOAD", b"PAYLOAX", 1) if corrupt else content


@pytest.fixture
def library(tmp_path):
    root = tmp_path / "lib"
    (root / "S").mkdir(parents=True)
    meta = "<ComicInfo><Series>S</Series><Number>1</Number><PageCount>2</PageCount></ComicInfo>"
    (root / "S" / "b.CBZ").write_bytes(make_zip([("2.png", "x"), ("10.png", "y"), ("ComicInfo.xml", meta)]))
    (root / "S" / "a.zip").write_bytes(make_zip([("1.png", "PAYLOAD"), ("sub/comicinfo.xml", meta)], corrupt=True))
    (root / "S" / "c.cbz").write_bytes(b"not a zip")
    (root / "S" / "notes.txt").write_text("x")
    return root


def test_listing_and_members(spark, library):
    listed = archives.list_archives(spark, str(library))
    names = [r.path.rsplit("/", 1)[1] for r in listed.orderBy("sort_path").select("path").collect()]
    assert names == ["a.zip", "b.CBZ", "c.cbz"]
    stored = archives.read_members(listed).withColumn("archive", F.substring_index("archive", "/", -1))
    rows = {(r.archive, r.name): r for r in stored.collect()}
    assert rows[("a.zip", "1.png")].crc_ok is False and rows[("b.CBZ", "2.png")].crc_ok is True
    assert rows[("c.cbz", None)].error.startswith("invalid_zip")
    pages = archives.pages_of(stored)
    assert [(r.page, r.name) for r in pages.filter("archive = 'b.CBZ'").orderBy("page").collect()] == [(1, "2.png"), (2, "10.png")]
    assert members.page_order_issues(pages).count() == 0
    table = {r.path: r for r in archives.archive_table(stored).collect()}
    assert (table["b.CBZ"].series, table["b.CBZ"].number, table["b.CBZ"].page_count) == ("S", "1", 2)
    real = stored.filter("member_index IS NOT NULL")
    assert [(r.archive, r.code) for r in members.metadata_uniqueness(real).collect()] == [("a.zip", "ARC005")]
    assert {r.code for r in archives.archive_issues(stored).collect()} == {"invalid_zip", "zip_crc_failed"}


def test_metadata_namespaces_and_guards(spark):
    texts = [
        '<x:ComicInfo xmlns:x="u"><x:Series> A </x:Series><Volume></Volume></x:ComicInfo>',
        "<!DOCTYPE a><ComicInfo/>", "<Other><Series>A</Series></Other>", "<ComicInfo><Series>A</ComicInfo>",
    ]
    df = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in enumerate(texts)] + [(4, bytearray(b"\xff<ComicInfo/>"))], "i int, xml binary")
    got = {r.i: r for r in archives.parse_metadata(df, "xml").collect()}
    assert got[0].series == "A" and got[0].volume is None and got[0].metadata_issue is None
    assert [got[i].metadata_issue for i in range(1, 5)] == ["metadata.no-declaration", "metadata.root", "metadata.well-formed", "metadata.utf-8"]


def test_oversized_metadata_names_the_limit(spark):
    big = make_zip([("ComicInfo.xml", "<ComicInfo><Series>S</Series>" + " " * (16 << 20) + "</ComicInfo>"), ("1.png", "x")])
    rows = archives.archive_table(archives.read_members(spark.createDataFrame([("a.cbz", bytearray(big))], "path string, content binary"))).collect()
    assert [(r.metadata_issue, r.series, r.page_count) for r in rows] == [("metadata.size", None, 1)]


def test_rejected_members_are_not_counted(spark):
    stored = [
        ("a", 0, "1.png", 1, 1, 1, 0, 0, False), ("a", 1, "../2.png", 1, 1, 0, 0, 0, False), ("a", 2, "ComicInfo.xml", 1, 1, 0, 0, 0, False),
        ("a", 3, "../ComicInfo.xml", 1, 1, 0, 0, 0, False), ("a", 4, "x.png", 1, 1, 0, 0o120777 << 16, 3, False), ("a", 5, "../comicinfo.xml", 1, 1, 0, 0, 0, False),
    ]
    df = spark.createDataFrame(
        stored, "archive string, member_index int, name string, file_size bigint, compress_size bigint, flag_bits int, external_attr bigint, create_system int, is_dir boolean"
    )
    assert archives.pages_of(df).count() == 0
    assert members.metadata_uniqueness(df).count() == 0 and members.duplicate_members(df).count() == 0


def test_inventory_resumes(spark, library, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    inventory.inventory_stream(spark, str(library), out, state, files_per_batch=1)
    first = spark.read.parquet(out).count()
    inventory.inventory_stream(spark, str(library), out, state)
    assert spark.read.parquet(out).count() == first
    (library / "S" / "d.cbz").write_bytes(make_zip([("1.png", "z")]))
    inventory.inventory_stream(spark, str(library), out, state)
    assert spark.read.parquet(out).count() == first + 1


def test_checksums_round_trip(spark, tmp_path):
    manifest = spark.createDataFrame([("b/x.cbz", "B" * 64), ("a/ y.cbz", "0" * 64)], "path string, sha256 string")
    target = str(tmp_path / "sums")
    checksums.write_checksums(manifest, target)
    assert [r.value for r in spark.read.text(target).collect()] == ["0" * 64 + "  a/ y.cbz", "B" * 64 + "  b/x.cbz"]
    listed, problems = checksums.read_checksums(spark, target)
    assert {(r.path, r.sha256) for r in listed.collect()} == {("b/x.cbz", "b" * 64), ("a/ y.cbz", "0" * 64)}
    assert problems.count() == 0
    with pytest.raises(AnalysisException):
        checksums.write_checksums(manifest, target)


def test_reports_are_not_overwritten(spark, tmp_path):
    df = spark.createDataFrame([("s", ["a", "b"])], "series string, tags array<string>")
    reports.write_report(df, "series-identity-audit", str(tmp_path))
    with pytest.raises(AnalysisException):
        reports.write_report(df, "series-identity-audit", str(tmp_path))


def test_plan_walk_keeps_document_order(spark, tmp_path):
    document = {"z": {"series": "A", "identity_policy": "volume-only"}, "a": [{"series": "A", "identity_policy": "volume_only"}, 3]}
    (tmp_path / "plan.json").write_text(json.dumps(document))
    (tmp_path / "bad.json").write_text("{")
    docs = plans.read_plans(spark, str(tmp_path))
    assert sorted(r.valid for r in docs.collect()) == [False, True]
    walked = plans.walk_records(docs).orderBy("seq").collect()
    assert [r.path for r in walked] == [[], ["z"], ["a", "#"]]
    records = plans.policy_records(plans.walk_nodes(docs)).orderBy("seq").collect()
    assert [r.policy for r in records] == ["volume-only", "volume_only"]


def test_manifest_roots(spark):
    document = {"root": "/outer", "m": {"a": "1" * 64, "list": [{"root": "/in", "path": "p", "hash": "A" * 64, "q": "2" * 64}]}}
    docs = spark.createDataFrame([("d", json.dumps(document))], "doc string, text string")
    got = {(r.root, r.path, r.sha256) for r in plans.flatten_manifest(plans.walk_nodes(docs), ["m"], "/default").collect()}
    assert got == {("/default", "a", "1" * 64), ("/in", "p", "a" * 64)}


def test_a_deep_document_is_written_in_linear_size(spark):
    deep = {"path": "x" * 1000}
    for i in range(200):
        deep = {"child": deep, "path": f"p{i}"}
    docs = spark.createDataFrame([("d", json.dumps(deep))], "doc string, text string")
    rows = plans.walk_records(docs).collect()
    assert len(rows) == 201 and sum(len(r.json) for r in rows) < 10 * len(json.dumps(deep))
    # No row shows a value that the document does not hold, and rows say where something is left out.
    assert sum(r.cut for r in rows) == 201 - 4 and not any('""' in r.json or "[0]" in r.json for r in rows)
    assert all(r.cut == ("x" * 1000 not in r.json) for r in rows)
    assert {r.path for r in plans.record_paths(plans.walk_nodes(docs)).collect()} >= {"p0", "p199"}


def test_metadata_is_read_at_any_depth(spark):
    texts = {
        "plain": "<ComicInfo><Series> A </Series><Number>1</Number></ComicInfo>",
        "nested": "<ComicInfo><Extra><Series>Inner</Series><Volume>3</Volume></Extra><Series>Later</Series></ComicInfo>",
        "cased": "<ComicInfo><SERIES>Upper</SERIES><number>7</number></ComicInfo>",
        "spaced": '<?xml version="1.0"?><c:ComicInfo xmlns:c="urn:c"><c:Page><c:Title>Deep</c:Title></c:Page><c:Series>S</c:Series></c:ComicInfo>',
        "empty": "<ComicInfo><Box><Series> </Series></Box><Series>Later</Series></ComicInfo>",
        "broken": "<ComicInfo><Extra><Series>x</Series></ComicInfo>",
        "marked": "<ComicInfo><Summary><![CDATA[ <Series>no</Series> ]]></Summary><Series>yes</Series></ComicInfo>",
    }
    df = spark.createDataFrame([(k, bytearray(v.encode())) for k, v in texts.items()], "name string, xml binary")
    got = {r.name: r for r in archives.parse_metadata(df, "xml").collect()}
    assert {k: r.series for k, r in got.items()} == {
        "plain": "A", "nested": "Inner", "cased": "Upper", "spaced": "S", "empty": None, "broken": None, "marked": "yes",
    }
    assert (got["nested"].volume, got["cased"].number, got["spaced"].title, got["plain"].number) == ("3", "7", "Deep", "1")
    assert got["marked"].summary == "<Series>no</Series>" and got["broken"].metadata_issue == "metadata.well-formed"


@pytest.mark.parametrize("whole", [True, False])
def test_table_inventory_reads_a_file_or_a_folder(spark, tmp_path, whole):
    # Larger tables are folders of files; what comes later is read once.
    rows = spark.range(30).selectExpr("id", "'x' || id AS name").repartition(1 if whole else 3)
    rows.write.parquet(str(tmp_path / "given"))
    table = next((tmp_path / "given").glob("part-*")) if whole else tmp_path / "given"
    for _ in range(2):
        out = inventory.table_inventory(spark, str(table.parent), table.name, rows.schema, str(tmp_path / "out"), str(tmp_path / "state"), lambda df: df.select("name"))
    assert sorted(r.name for r in out.collect()) == sorted(f"x{i}" for i in range(30))


def test_batches_of_members_are_bounded_by_their_metadata(monkeypatch):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as out:
        out.writestr("ComicInfo.xml", "x" * 100)
    given = archives.pd.DataFrame({"path": [f"{i}.cbz" for i in range(9)], "content": [buffer.getvalue()] * 9})
    monkeypatch.setattr(archives, "_BATCH_BYTES", 300, raising=False)
    assert [len(batch) for batch in archives._explode([given])] == [3, 3, 3]
