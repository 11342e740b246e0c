import hashlib
import shutil

from lexmill.streaming import arrivals


def state(spark, out):
    rows = {r.path.rsplit("/", 1)[1]: (r.status, r.pages) for r in arrivals.ledger(spark, out).collect()}
    return rows, sorted((r.page, r.text) for r in arrivals.pages(spark, out).collect())


def test_files_are_taken_in_once(spark, tmp_path):
    folder, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    (folder / "sub").mkdir(parents=True)
    run = lambda c=check: arrivals.take_in(spark, str(folder), out, c, per_batch=2).awaitTermination(120)
    (folder / "a.txt").write_bytes(b"\xef\xbb\xbfone\ftwo")
    (folder / "b.txt").write_bytes(b"\xff\xfe broken")
    (folder / "sub/c.txt").write_bytes("drei é".encode())
    (folder / "copy.txt").write_bytes(b"\xef\xbb\xbfone\ftwo")
    (folder / "blank.txt").write_bytes(b" \f ")
    (folder / "other.pdf").write_bytes(b"x")
    run()
    files, pages = state(spark, out)
    assert pages == [(1, "drei é"), (1, "one"), (2, "two")]
    assert len(files) == 4 and {files.get("a.txt"), files.get("copy.txt")} == {("done", 2), None}
    assert files["b.txt"] == ("broken", 0) and files["blank.txt"] == ("broken", 0) and files["c.txt"] == ("done", 1)
    errors = {r.error for r in arrivals.ledger(spark, out).where("status = 'broken'").collect()}
    assert any("UnicodeDecodeError" in e for e in errors) and any("holds no text" in e for e in errors)

    run()
    assert state(spark, out) == (files, pages)
    shutil.copy(folder / "sub/c.txt", folder / "again.txt")
    (folder / "b2.txt").write_bytes(b"mended")
    run()
    files, pages = state(spark, out)
    assert pages == [(1, "drei é"), (1, "mended"), (1, "one"), (2, "two")] and files["b2.txt"] == ("done", 1) and "again.txt" not in files
    run(str(tmp_path / "other_check"))  # even where the stream has forgotten what it read
    assert state(spark, out)[1] == pages
    assert {r.sha for r in arrivals.ledger(spark, out).collect()} >= {hashlib.sha256(b"mended").hexdigest()}


def test_a_stop_between_pages_and_ledger_loses_and_doubles_nothing(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    (folder / "a.txt").write_bytes(b"one\ftwo")
    arrivals.take_in(spark, str(folder), str(out), str(tmp_path / "check")).awaitTermination(120)
    shutil.rmtree(out / "ledger")  # as if the batch had stopped before it
    assert arrivals.pages(spark, str(out)).count() == 0
    shutil.rmtree(tmp_path / "check" / "commits")
    arrivals.take_in(spark, str(folder), str(out), str(tmp_path / "check")).awaitTermination(120)
    assert state(spark, str(out))[1] == [(1, "one"), (2, "two")]
