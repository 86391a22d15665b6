import sys
import types

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringStartsWith

from glyphflow.sources import documents as D
from glyphflow.sources.pdf import blocks_of_spans

FORM = {"format": "glyphflow.sources.documents:FORM_FEED"}


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, pages in files.items():
        (folder / f"{name}.txt").write_bytes("\f".join(pages).encode())


class Counting(D.FormFeed):
    """A stand-in that notes every page it extracts."""

    def __init__(self, notes, broken=()):
        self.notes, self.broken = notes, set(broken)

    def open(self, data, password):
        if data.startswith(b"broken"):
            raise OSError("no document")
        return super().open(data, password)

    def rows(self, pages, number):
        with open(self.notes, "a") as f:
            f.write(f"{number}\n")
        if number in self.broken:
            raise ValueError("no page")
        yield from super().rows(pages, number)


@pytest.fixture
def counting(tmp_path, monkeypatch):
    """A module that tasks can import with a counting format, and what it has noted."""
    notes = tmp_path / "notes"
    source = f"from tests.test_documents import Counting\nFORMAT = Counting({str(notes)!r}, [4])\n"
    (tmp_path / "counting_format.py").write_text(source)
    return str(tmp_path), lambda: sorted(map(int, notes.read_text().split())) if notes.exists() else []


def test_a_page_filter_reads_only_those_pages(spark, tmp_path):
    put(tmp_path / "in", a=[f"a{i}" for i in range(1, 41)], b=[f"b{i}" for i in range(1, 6)])
    read = []

    class Noting(D.FormFeed):
        def rows(self, pages, number):
            read.append((pages[0], number))
            yield from super().rows(pages, number)

    module = types.ModuleType("noting_format")
    module.FORMAT = Noting()
    sys.modules["noting_format"] = module
    reader = D.PushingReader({"path": str(tmp_path / "in"), "format": "noting_format:FORMAT", "task_bytes": "40"})
    left = list(reader.pushFilters([GreaterThan(("page_number",), 3), LessThanOrEqual(("page_number",), 30), In(("page_number",), (2, 5, 29, 31)), StringStartsWith(("path",), "a"), EqualTo(("text",), "x")]))
    assert [type(f) for f in left] == [GreaterThan, LessThanOrEqual, In, EqualTo]
    parts = reader.partitions()
    assert len(parts) == 4 and {p.parts for p in parts} == {4} and all(p.files == ["a.txt"] for p in parts)
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["page_number"], r["text"]) for r in rows] == [(5, "a5"), (29, "a29")] and read == [(b"a1", 5), (b"a1", 29)]


def test_conditions_of_a_query_reach_the_source(spark, tmp_path):
    put(tmp_path / "in", a=[f"a{i}" for i in range(1, 41)], b=[f"b{i}" for i in range(1, 6)])
    pages = D.read_pages(spark, str(tmp_path / "in"), task_bytes=40, pushdown=True, **FORM)
    assert pages.rdd.getNumPartitions() == 5 and pages.count() == 45
    some = pages.where("page_number between 3 and 5 and path like 'a%'").select("path", "page_number", "text")
    assert some.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, some.collect())) == [("a.txt", i, f"a{i}") for i in (3, 4, 5)]
    assert pages.where("page_number in (1, 5) and path = 'b.txt'").count() == 2
    assert pages.where("page_number = 41 or text = 'b2'").count() == 1


def test_conditions_given_and_frames_scanned_twice(spark, tmp_path):
    put(tmp_path / "in", a=[f"a{i}" for i in range(1, 41)], b=[f"b{i}" for i in range(1, 6)])
    pages = D.read_pages(spark, str(tmp_path / "in"), **FORM)
    both = pages.where("page_number = 1").union(pages.where("page_number = 2"))
    assert sorted(r.text for r in both.collect()) == ["a1", "a2", "b1", "b2"]
    some = D.read_pages(spark, str(tmp_path / "in"), first_page=39, beginning="a", task_bytes=40, **FORM)
    assert some.rdd.getNumPartitions() == 4 and sorted(r.text for r in some.collect()) == ["a39", "a40"]


def test_every_page_is_in_one_slice(tmp_path):
    for n in (1, 2, 7, 500):
        for parts in (1, 3, 9):
            made = [p for k in range(parts) for p in D.Wanted().of(n * k // parts + 1, n * (k + 1) // parts)]
            assert made == list(range(1, n + 1))
    assert [s.files for s in D.packed([("a", 5), ("b", 4), ("c", 6), ("d", 25), ("e", 1)], 10)] == [["a", "b"], ["d"], ["d"], ["d"], ["c", "e"]]


def test_failures_are_rows(spark, tmp_path, monkeypatch, counting):
    folder, noted = counting
    put(tmp_path / "in", a=["1", "2", "3", "4", "5"], c=["broken"])
    monkeypatch.syspath_prepend(folder)
    reader = D.PagedReader({"path": str(tmp_path / "in"), "format": "counting_format:FORMAT", "task_bytes": "4"})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    errors = [(r["path"], r["page_number"], r["error"]) for r in rows if r["error"]]
    assert errors == [("a.txt", 4, "ValueError: no page"), ("c.txt", None, "OSError: no document")] and noted() == [1, 2, 3, 4, 5]


class Page:
    rect = types.SimpleNamespace(width=100.0, height=200.0)

    def __init__(self, text):
        self.text = text

    def get_text(self, kind):
        span = {"text": self.text, "font": "F", "size": 10.0, "bbox": (1.0, 2.0, 3.0, 4.0)}
        return {"blocks": [{"type": 1}, {"type": 0, "lines": [{"spans": [span]}]}]}


def test_spans_of_a_document_page_by_page(spark, tmp_path, monkeypatch):
    """A stand-in for the library: a document is a list of pages."""
    put(tmp_path / "in", a=["one", "two", "three"])
    monkeypatch.setattr(D, "opened", lambda data, password: [Page(t.decode()) for t in data.split(b"\f")])
    reader = D.PagedReader({"path": str(tmp_path / "in"), "first_page": "2", "last_page": "2"})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["page_number"], r["text"], r["block_no"]) for r in rows] == [(2, "two", 0)]
    blocks = blocks_of_spans(spark.createDataFrame([tuple(r.values()) for r in rows], D.SPANS)).collect()
    assert [(b.path, b.page_number, b.raw_text, b.font_name) for b in blocks] == [("a.txt", 2, "two", "F")]


def test_what_failed_and_repeated_writes_leave(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = spark.range(40).selectExpr("concat('d', id % 3, '/', id, '.txt') AS name", "concat('text ', id, '\f', 'more') AS content").repartition(4)
    broken = rows.withColumn("content", F.when(F.col("name") == "d0/39.txt", F.raise_error(F.lit("lost"))).otherwise("other"))
    with pytest.raises(Exception, match="lost"):
        D.write_files(broken, folder)
    assert D.listed(folder) == []  # some files may be there, none is committed
    for _ in range(2):
        D.write_files(rows, folder)
    (tmp_path / "out" / "stray.txt").write_text("of a task that died")
    got = D.read_pages(spark, folder, **FORM)
    assert sorted((r.path, r.page_number, r.text) for r in got.collect()) == sorted(x for i in range(40) for x in ((f"d{i % 3}/{i}.txt", 1, f"text {i}"), (f"d{i % 3}/{i}.txt", 2, "more")))
    assert not list((tmp_path / "out" / D.PENDING).glob("*"))
    D.write_files(rows.limit(3).selectExpr("concat('x', name) AS name", "cast(content AS binary) AS content"), folder)
    assert len(D.listed(folder)) == 43
    D.write_files(rows.where("name like 'd1%'"), folder, "overwrite")
    assert {n[:2] for n, _ in D.listed(folder)} == {"d1"}


def test_names_that_are_no_files(spark, tmp_path):
    for name in ("../a", "_a", "", "/a", "a/../../b"):
        with pytest.raises(Exception, match="not a file name"):
            D.write_files(spark.createDataFrame([(name, "x")], "name string, content string"), str(tmp_path / "o"))


def test_nothing_written_is_nothing_read(spark, tmp_path):
    D.write_files(spark.createDataFrame([], "name string, content string"), str(tmp_path / "o"))
    assert D.read_pages(spark, str(tmp_path / "o"), **FORM).count() == 0
