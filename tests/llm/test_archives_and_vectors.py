import io
import struct
import zipfile

import numpy as np
import pyarrow as pa
import pytest

from gapwright.llm import topk, warczip


class Memory:
    """What RangeFile needs of a pyarrow file."""

    def __init__(self, data):
        self.data, self.at = data, 0

    def size(self):
        return len(self.data)

    def seek(self, at):
        self.at = at

    def read(self, n):
        return self.data[self.at : self.at + n]


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_directories():
    data = zipped(a=b"hello", b=b"")
    f = warczip.RangeFile(Memory(data))
    found = warczip.members(f)
    at, size = warczip.data_range(f, found["a"])
    assert f.read(at, size) == b"hello" and found["b"].size == 0
    with pytest.raises(ValueError, match="not a ZIP"):
        warczip.members(warczip.RangeFile(Memory(b"nothing here")))
    squeezed = io.BytesIO()
    with zipfile.ZipFile(squeezed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 1000)
    f = warczip.RangeFile(Memory(squeezed.getvalue()))
    with pytest.raises(ValueError, match="compressed"):
        warczip.data_range(f, warczip.members(f)["a"])


def test_zip64_directory():
    """A directory whose sizes, offsets and counts are all in their ZIP64 places."""
    name, body = b"archive/x", b"payload"
    local = b"PK\x03\x04" + struct.pack("<5H3I2H", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 0) + name + body
    extra = struct.pack("<2H3Q", 1, 24, len(body), len(body), 0)
    entry = b"PK\x01\x02" + struct.pack("<6H3I5H2I", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    end64 = b"PK\x06\x06" + struct.pack("<Q2H2I4Q", 44, 45, 45, 0, 0, 1, 1, len(entry), len(local))
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, len(local) + len(entry), 1)
    end = b"PK\x05\x06" + struct.pack("<4H2IH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 3) + b"end"
    f = warczip.RangeFile(Memory(local + entry + end64 + locator + end))
    m = warczip.members(f)["archive/x"]
    assert (m.size, m.header) == (7, 0)
    assert f.read(*warczip.data_range(f, m)) == body


def test_records_round_trip():
    data = warczip.record(7, "http://e.org/ü\r\nX: y", b"<p>\r\n\r\n</p>", "ABC")
    r = warczip.parse(data)
    assert r["warc-type"] == "response" and r["block"].endswith(b"<p>\r\n\r\n</p>") and "x" not in r
    r = warczip.parse(warczip.record("a b", None, b"xyz", "ABC", 3, True))
    assert r["warc-refers-to"] == "<urn:page:3>" and b"Content-Length: 3" in r["block"] and not r["block"].endswith(b"xyz")


@pytest.mark.parametrize("least", [0, 4])
def test_pages(spark, least):
    rows = [(3, "http://a/", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "http://b/", None), (4, "http://c/", ""), (5, "", "x"), (6, "u", "x"), (None, "n", "<p>é</p>"), (None, "n", "only"), (7, "r", "rep"), (7, "r", "rep"), (8, "l", "y" * 300_000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, record_type string").repartition(3)
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warczip.round_trip(df, least).collect())
    want = []
    for page, _, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(same, default=None)
        revisit = len(payload) >= least and first is not None and page != first
        want.append((str(page), len(payload), warczip.digest(payload), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=lambda x: tuple(map(str, x))) or sorted(got, key=str) == sorted(want, key=str)


def test_ids_as_text_and_one_hot_payload(spark):
    rows = [("", "u", "a"), (None, "u", "b"), ("x", "u", "a"), *((f"p{i:03d}", "v", "same") for i in range(200))]
    df = spark.createDataFrame(rows, "page_id string, url string, html string").repartition(3)
    got = {r["page_id"]: r for r in warczip.round_trip(df).collect()}
    assert len(got) == len(rows) and got["x"]["refers_to"] == "" and got[""]["record_type"] == got[None]["record_type"] == "response"
    assert sum(r["refers_to"] == "p000" for r in got.values()) == 199


def test_no_pages(spark):
    assert warczip.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_broken_package(spark, tmp_path):
    (tmp_path / "x.wacz").write_bytes(b"PK")
    with pytest.raises(Exception, match="not a ZIP file"):
        warczip.read_packages(spark.createDataFrame([(f"file://{tmp_path}/x.wacz",)], "package string")).collect()


def plain_top(rows, k, every):
    best = []
    clean = {}
    for i, x in rows:
        if i is not None and x is not None and all(v is not None and np.isfinite(v) for v in x):
            clean[i, tuple(np.floor(256 * np.array(x, dtype=np.float64)).astype(int))] = None
    for q, a in clean:
        if q % every:
            continue
        scores = sorted((-sum(u * v for u, v in zip(a, b, strict=False)), i) for i, b in clean if i != q)[:k]
        best += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(best)


@pytest.mark.parametrize("block", [8, 8192])
def test_top_k_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "LEAST_BLOCK", min(block, 64))
    monkeypatch.setattr(topk, "QUERY_BYTES", 8 * 6 * block)
    draw = np.random.default_rng(0)
    rows = [(i, [float(np.float32(v)) for v in draw.normal(size=6) * (1 + i % 3)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)]  # many equal vectors
    rows += [(2000, None), (2001, [None] * 6), (2002, [float("nan")] * 6), (2004, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 6), (2006, []), (2008, [1.0, 2.0]), (5, rows[5][1]), (2010, [0.0] * 6)]
    df = spark.createDataFrame([(i, x, "c") for i, x in rows], "vec_id bigint, embedding array<float>, rank string").repartition(4)
    got = sorted(tuple(r) for r in topk.top_k(df, k=5, every=10).collect())
    assert got == plain_top(rows, 5, 10)


def test_ties_across_blocks(spark, monkeypatch):
    """Many candidates share the score of rank k, in different blocks: the smaller ids win."""
    monkeypatch.setattr(topk, "LEAST_BLOCK", 8)
    monkeypatch.setattr(topk, "BLOCK", 8)
    rows = [(i, [1.0 if j == i % 4 else 0.0 for j in range(4)] + [float(i % 16 == j) for j in range(16)] + [2.0]) for i in range(160)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)
    assert sorted(tuple(r) for r in topk.top_k(df, k=5, every=10).collect()) == plain_top(rows, 5, 10)


def test_one_vector_on_a_third_of_the_rows(spark):
    draw = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else [float(np.float32(v)) for v in draw.normal(size=3)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)
    assert sorted(tuple(r) for r in topk.top_k(df, k=5, every=50).collect()) == plain_top(rows, 5, 50)


def test_components_beyond_64_bits(spark):
    df = spark.createDataFrame([(0, [1e30, 0.0]), (1, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(df).collect()
    df = spark.createDataFrame([(0, [1e10, 0.0]), (1, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(df)


def test_few_or_no_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert topk.top_k(make([])).count() == 0
    assert topk.top_k(make([(0, [1.0])])).count() == 0
    assert [tuple(r) for r in topk.top_k(make([(0, [1.0]), (1, [2.0])])).collect()] == [(0, 1, 1, 256 * 512)]


def test_quantised_rows():
    assert topk._matrix(pa.array([[1, -2], []], pa.list_(pa.int64())), 3).tolist() == [[1, -2, 0], [0, 0, 0]]
