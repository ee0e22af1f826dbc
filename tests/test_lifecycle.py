import io
import json
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from provena.operators import lifecycle
from provena.sources import archive

DOCUMENTS = "document int, library string, status string, path string, created_at string, updated_at string, content_hash string, extra string"
OVERRIDES = "document int, library string, legal_hold boolean, status string, updated_at timestamp"


def tables(spark, tmp_path):
    for i in range(8):
        (tmp_path / f"f{i}").write_text("x")
    at = lambda i: str(tmp_path / f"f{i}")
    rows = [
        (0, "a", "ready", at(0), "2020-01-01", None, "h0", "e"),
        (1, "a", "ready", at(1), "2024-01-01", None, "h1", "e"),
        (2, "p", "ready", at(2), None, "2020-01-01", "h2", None),
        (3, "p", "ready", at(3), "2020-01-01", None, "h3", "e"),
        (4, "p", "queued", at(4), "2023-12-01", None, "h4", "e"),
        (5, "s", "ready", at(5), "2020-01-01", None, "h5", "e"),
        (6, "p", "ready", at(4), "2020-01-01", None, "h6", "e"),
        (7, "p", "ready", str(tmp_path / "never"), "2020-01-01", None, None, "e"),
        (8, "p", "ready", None, "not a date", None, None, "e"),
        (None, None, "ready", at(7), "2020-01-01", None, None, "e"),
    ]
    documents = spark.createDataFrame(rows, DOCUMENTS)
    chunks = documents.where("document IS NOT NULL").select("document", F.explode(F.array(F.lit(0), F.lit(1))).alias("ordinal"))
    overrides = spark.createDataFrame([(3, "p", True, None, None), (5, "s", False, "old", None), (99, "z", True, "kept", None)], OVERRIDES)
    policies = spark.createDataFrame([("a", 365, "archive"), ("p", 365, "purge"), ("s", 365, "soft_delete"), ("off", 0, "purge")], "library string, retention_days int, action string")
    return documents, chunks, overrides, policies


def now(day="2024-02-01"):
    return F.lit(day).cast("timestamp")


def test_apply_does_what_the_dry_run_told(spark, tmp_path):
    documents, chunks, overrides, policies = tables(spark, tmp_path)
    told = {r.document: r.outcome for r in lifecycle.plan(documents, policies, overrides, now()).collect()}
    assert told == {0: "archived", 2: "purged", 3: "legal_hold_protected", 5: "soft_deleted", 6: "purged", 7: "purged"}
    done = lifecycle.apply(str(tmp_path / "run"), documents, chunks, overrides, policies, now(), "me")
    assert {r.document: r.outcome for r in done["plan"].collect()} == told
    assert done["documents"].columns == documents.columns
    assert {r.document: r.status for r in done["documents"].collect()} == {0: "archived", 1: "ready", 3: "ready", 4: "queued", 5: "soft_deleted", 8: "ready", None: "ready"}
    assert {r.document for r in done["chunks"].collect()} == {0, 1, 3, 4, 5, 8}
    assert {r.document: (r.legal_hold, r.status) for r in done["overrides"].collect()} == {0: (False, "archived"), 2: (False, "purged"), 3: (True, None), 5: (False, "soft_deleted"), 6: (False, "purged"), 7: (False, "purged"), 99: (True, "kept")}
    assert sorted((r.document, r.sha256, r.actor) for r in done["audit"].collect()) == [(2, "h2", "me"), (6, "h6", "me"), (7, None, "me")]
    assert {os.path.basename(r.path): r.removed for r in done["removed"].collect()} == {"f2": True, "never": False}
    assert sorted(p.name for p in tmp_path.glob("f*")) == ["f0", "f1", "f3", "f4", "f5", "f6", "f7"]


def test_a_run_is_taken_up_where_it_broke_off(spark, tmp_path, monkeypatch):
    documents, chunks, overrides, policies = tables(spark, tmp_path)
    folder, once = str(tmp_path / "run"), lifecycle._once

    def breaks(df, path):
        if path.endswith("/overrides"):
            raise OSError("lost")
        return once(df, path)

    monkeypatch.setattr(lifecycle, "_once", breaks)
    with pytest.raises(OSError):
        lifecycle.apply(folder, documents, chunks, overrides, policies, now())
    assert (tmp_path / "f2").exists()
    monkeypatch.setattr(lifecycle, "_once", once)
    later = now("2034-01-01")
    done = lifecycle.apply(folder, documents, chunks, overrides, policies, later)
    assert {r.document for r in done["plan"].collect() if r.outcome == "purged"} == {2, 6, 7} == {r.document for r in done["audit"].collect()}
    assert not (tmp_path / "f2").exists()
    again = lifecycle.apply(folder, documents.limit(0), chunks, overrides, policies, later)
    assert again["documents"].count() == 7 and again["removed"].where("removed").count() == 1


def test_archives_round_trip(spark, tmp_path):
    rows = [("Lib A", 1, "one.txt", "text/plain", "ready", b"\x00one"), ("Lib A", 2, "two.md", "text/markdown", "queued", b""), ("B", 3, "d.csv", "text/csv", "ready", None)]
    documents = spark.createDataFrame([tuple(bytearray(v) if isinstance(v, bytes) else v for v in r) for r in rows], "library string, id int, filename string, media_type string, status string, content binary")
    chunks = spark.createDataFrame([("Lib A", 1, 1, "second è", "p 2"), ("Lib A", 1, 0, "first", "p 1"), ("B", 3, 0, "", None)], "library string, id int, ordinal int, text string, source_locator string")
    (tmp_path / "packs").mkdir()
    packs = archive.export(documents, chunks, str(tmp_path / "packs")).collect()
    assert sorted((r.library, os.path.basename(r.path), r.n_documents, r.n_chunks) for r in packs) == [("B", "B.tar.gz", 1, 1), ("Lib A", "Lib_A.tar.gz", 2, 2)]
    with tarfile.open(tmp_path / "packs" / "Lib_A.tar.gz") as tar:
        assert sorted(tar.getnames()) == ["documents.json", "files/1_one.txt", "files/2_two.md", "manifest.json"]
    found, pieces, refused = archive.imported(archive.read(archive.list_packs(spark, str(tmp_path / "packs"))))
    assert sorted((r.library, r.id, r.filename, r.media_type, r.status, bytes(r.content)) for r in found.collect()) == sorted((a, str(b), c, d, e, f or b"") for a, b, c, d, e, f in rows)
    assert sorted((r.id, r.ordinal, r.text, r.source_locator) for r in pieces.collect()) == [("1", 0, "first", "p 1"), ("1", 1, "second è", "p 2"), ("3", 0, "", "")]
    assert refused.count() == 0


def pack(path, *members, documents=None, link=None):
    with tarfile.open(path, "w:gz") as tar:
        for name, body in [("manifest.json", b"{}"), ("documents.json", json.dumps(documents or []).encode()), *members]:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
        if link:
            info = tarfile.TarInfo(link)
            info.type, info.linkname = tarfile.SYMTYPE, "/etc/passwd"
            tar.addfile(info)


def test_refused_archives(spark, tmp_path):
    name = lambda n: str(tmp_path / f"{n}.tar.gz")
    pack(name("suspicious_path"), ("files/../x", b"x"))
    pack(name("member_too_large"), ("files/x", b"x" * 2000))
    pack(name("archive_too_large"), *[(f"files/{i}", b"x" * 900) for i in range(30)])
    pack(name("repeated_member"), ("files/x", b"x"), ("files/x", b"y"))
    pack(name("not_a_file"), link="files/l")
    pack(name("name_not_allowed"), documents=[{"document": {"id": "1", "filename": "ok.txt"}}, {"document": {"id": "2", "filename": "a/b.txt"}}])
    pack(name("fine"), documents=[{"document": {"id": "1", "filename": "ok.txt"}, "chunks": [{"text": "t"}]}, {"chunks": []}])
    (tmp_path / "broken_archive.tar.gz").write_bytes(b"no gzip")
    with tarfile.open(name("no_manifest"), "w:gz"):
        pass
    paths = spark.createDataFrame([(str(p),) for p in tmp_path.glob("*.tar.gz")] + [(None,)], "path string")
    found, pieces, refused = archive.imported(archive.read(paths, largest=1000))
    got = {os.path.basename(r.pack).partition(".")[0]: r.error for r in refused.collect()}
    assert got == {n: n for n in ("suspicious_path", "member_too_large", "archive_too_large", "repeated_member", "not_a_file", "name_not_allowed", "broken_archive", "no_manifest")}
    (document,) = found.collect()
    assert (document.library, document.id, bytes(document.content)) == ("Biblioteca Importata", "1", b"") and pieces.count() == 1
