"""Paged sources, split transport files, and the log of submissions."""

import json
import struct
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from signflow.functions.storage import put_if_absent
from signflow.operators.curation import Submissions
from signflow.sources.paged import fetch_all, fetch_keys, read_pages
from signflow.sources.transport import read_transport

# --- pages ----------------------------------------------------------------------------


@pytest.fixture
def service():
    """45 items in pages of ten; pages named in ``bad`` fail so many times before they work, ``down`` ones always."""
    state = {"asked": [], "bad": {}, "down": set(), "refused": set()}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            if "ids=" in self.path:
                ids = self.path.split("ids=")[1].split(";")
                state["asked"].append(ids)
                if state["down"] & set(ids):
                    self.send_error(500)
                    return
                self.send_response(200)
                self.end_headers()
                self.wfile.write(json.dumps({"found": [{"of": {"id": int(i)}, "x": "ü"} for i in reversed(ids) if i.isdigit()]}).encode())
                return
            offset = int(self.path.split("offset=")[1])
            state["asked"].append(offset)
            if offset in state["refused"]:
                self.send_error(404)
                return
            if offset in state["down"] or state["bad"].get(offset, 0) > 0:
                state["bad"][offset] = state["bad"].get(offset, 0) - 1
                self.send_error(503)
                return
            body = json.dumps({"meta": {"total": 45}, "items": [{"n": i, "é": "ü"} for i in range(offset, min(offset + 10, 45))]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    state["options"] = {"url": f"http://127.0.0.1:{server.server_port}/items?limit={{limit}}&offset={{offset}}", "items": "items", "total": "meta.total", "size": 10, "retries": 3, "backoff": 0.01}
    yield state
    server.shutdown()


def numbers(df):
    return sorted(json.loads(r.item)["n"] for r in df.collect())


def test_pages_are_partitions_and_are_tried_again(spark, service):
    service["bad"] = {10: 2, 30: 3}
    df = read_pages(spark, **service["options"])
    assert df.rdd.getNumPartitions() == 5
    rows = df.collect()
    assert [(r.page, r.place) for r in sorted(rows)] == [(i // 10, i % 10) for i in range(45)]
    assert rows[0].item == '{"n": 0, "é": "ü"}'
    service["refused"] = {20}
    with pytest.raises(Exception, match="404"):
        read_pages(spark, **service["options"]).collect()


def test_a_stopped_fetch_goes_on(spark, service, tmp_path):
    path = f"file://{tmp_path}/pages"
    service["down"] = {30}
    with pytest.raises(Exception, match="503"):
        fetch_all(spark, path, batch=2, **service["options"])
    service["down"], service["asked"] = set(), []
    assert numbers(fetch_all(spark, path, batch=2, **service["options"])) == list(range(45))
    # the first two pages were there; the one that had been fetched beside the failing one was not
    assert sorted(set(service["asked"])) == [0, 20, 30, 40] and service["asked"].count(20) == 1
    service["asked"] = []
    assert fetch_all(spark, path, batch=2, **service["options"]).count() == 45 and service["asked"] == [0]


def test_keys_are_fetched_once(spark, service, tmp_path):
    path, how = f"file://{tmp_path}/keys", {"url": service["options"]["url"].split("?")[0] + "?ids={keys}", "key": "of.id", "items": "found", "batch": 3, "at_once": 2, "retries": 1, "backoff": 0.01}
    keys = spark.createDataFrame([(str(i),) for i in range(11)] + [("zz",), (None,), ("3",)], "key string")
    service["down"] = {"9"}
    with pytest.raises(Exception, match="500"):
        fetch_keys(keys, path, **how)
    # batches of three in order of the keys, as text: the first two were stored together
    service["down"], service["asked"] = set(), []
    got = fetch_keys(keys, path, **how)
    assert {(r.key, r.item) for r in got.collect()} == {(str(i), f'{{"of": {{"id": {i}}}, "x": "ü"}}') for i in range(11)}
    assert sorted(x for ids in service["asked"] for x in ids) == ["5", "6", "7", "8", "9", "zz"] and all(len(ids) <= 3 for ids in service["asked"])
    service["asked"] = []
    assert fetch_keys(keys, path, **how).count() == 11 and service["asked"] == []
    assert fetch_keys(keys.where("false"), f"file://{tmp_path}/none", **how).count() == 0


def test_pages_of_files(spark, tmp_path):
    for i, page in enumerate([[1, 2], [], [3]]):
        (tmp_path / f"p{i + 1}.json").write_text(json.dumps(page))
    how = {"url": f"file://{tmp_path}/p{{page}}.json", "pages": 3, "first": 1}
    assert [(r.page, r.item) for r in read_pages(spark, **how).orderBy("page", "place").collect()] == [(0, "1"), (0, "2"), (2, "3")]
    store = f"file://{tmp_path}/store"
    assert fetch_all(spark, store, **how).count() == 3
    for i in range(3):
        (tmp_path / f"p{i + 1}.json").unlink()
    assert fetch_all(spark, store, **how).count() == 3  # an empty page counts as fetched
    with pytest.raises(Exception, match="total"):
        read_pages(spark, url="file:///x").count()


# --- transport files ---------------------------------------------------------------------


def ibm(x, length=8):
    if x is None:
        return b"." + bytes(length - 1)
    if x == 0:
        return bytes(length)
    sign, x, e = (128 if x < 0 else 0), abs(x), 64
    while x >= 1:
        x, e = x / 16, e + 1
    while x < 1 / 16:
        x, e = x * 16, e - 1
    return bytes([sign | e]) + int(x * (1 << 56)).to_bytes(7, "big")[: length - 1]


def transport(*members):
    """A file of tables (name, [(variable, length or None for texts of 11)], rows)."""
    pad = lambda b, n: b + b" " * (n - len(b))
    head = lambda name, tail: pad(b"HEADER RECORD*******" + name + b" HEADER RECORD!!!!!!!" + tail, 80)
    out = head(b"LIBRARY", b"0" * 30) + pad(b"SAS     SAS     SASLIB  9.4     X", 80) + pad(b"01JAN26:00:00:00", 80)
    for name, variables, rows in members:
        out += head(b"MEMBER ", b"000000000000000001600000000140") + head(b"DSCRPTR", b"0" * 30) + pad(b"SAS     " + pad(name.encode(), 8) + b"SASDATA 9.4     X", 80) + pad(b"01JAN26:00:00:00", 80)
        at, var = 0, b""
        for i, (n, length) in enumerate(variables):
            var += struct.pack(">hhhh8s40s8shhh2s8shhl52s", 1 if length else 2, 0, length or 11, i + 1, pad(n.encode(), 8), pad(b"", 40), pad(b"", 8), 0, 0, 0, b"\0\0", pad(b"", 8), 0, 0, at, bytes(52))
            at += length or 11
        out += head(b"NAMESTR", b"000000%04d00000000000000000000" % len(variables)) + pad(var, -(-len(var) // 80) * 80) + head(b"OBS    ", b"0" * 30)
        data = b"".join(ibm(x, length) if length else pad((x or "").encode(), 11) for row in rows for x, (_, length) in zip(row, variables, strict=True))
        out += pad(data, -(-len(data) // 80) * 80)
    return out


def test_transport_files_are_split(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(float(i), None if i % 7 == 0 else float(x), "" if i % 5 == 0 else f"tëxt {i}"[:9]) for i, x in enumerate(np.concatenate([rng.normal(0, 10.0 ** rng.integers(-30, 30, 3000)), [0.0, -1.0, 0.1, 1e-70, 7e70, -65535.5]]))]
    path = tmp_path / "big.xpt"
    path.write_bytes(transport(("BIG", [("N", 8), ("X", 8), ("T", None)], rows)))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("mapreduce.input.fileinputformat.split.maxsize", "20000")
    try:
        got = read_transport(spark, f"file://{path}", chunk_records=40)
        files = got.select(F.spark_partition_id().alias("p")).distinct().count()
        found = sorted((r.N, r.X, r["T"]) for r in got.collect() if r.X is not None)
        nulls = got.where("X is null").count()
    finally:
        conf.unset("mapreduce.input.fileinputformat.split.maxsize")
    assert files > 3
    assert (len(found), nulls) == (sum(x is not None for _, x, _ in rows), sum(x is None for _, x, _ in rows))
    other = {int(r.N): r.X for r in pd.read_sas(path, format="xport", encoding="utf-8").itertuples()}
    for n, x, text in found:
        _, true, word = rows[int(n)]
        assert text == word and abs(x - true) <= 1e-14 * abs(true)
        # the other reader takes zero for the smallest number
        assert int(n) not in other or true == 0 or abs(x - other[int(n)]) <= 1e-15 * abs(x)


def test_tables_lengths_and_padding_of_transport_files(spark, tmp_path):
    path = tmp_path / "two.xpt"
    path.write_bytes(transport(("ONE", [("A", 3), ("B", 2), ("T", None)], [(1.0, -2.0, "x"), (None, 0.5, "")]), ("TWO", [("T", None)], [("a",), ("",), ("b",)]), ("NONE", [("Z", 8)], [])))
    one = read_transport(spark, f"file://{path}", "ONE").collect()
    assert sorted(map(tuple, one), key=str) == [(1.0, -2.0, "x"), (None, 0.5, "")]
    assert sorted(r["T"] for r in read_transport(spark, f"file://{path}", "TWO").collect()) == ["", "a", "b"]
    assert read_transport(spark, f"file://{path}", "NONE").count() == 0
    with pytest.raises(ValueError, match="has the tables"):
        read_transport(spark, f"file://{path}")
    with pytest.raises(KeyError):
        read_transport(spark, f"file://{path}", "OTHER")
    (tmp_path / "no.xpt").write_bytes(b"x" * 160)
    with pytest.raises(ValueError, match="no transport file"):
        read_transport(spark, f"file://{tmp_path}/no.xpt")
    (tmp_path / "cut.xpt").write_bytes(path.read_bytes()[:-7])
    with pytest.raises(ValueError, match="whole number"):
        read_transport(spark, f"file://{tmp_path}/cut.xpt")


# --- submissions ----------------------------------------------------------------------------

COLUMNS = "id string, curator string, created string, title string, note string, contribution string"


def at_once(*calls):
    """What each call raises, or None, run side by side."""
    out, gate = [None] * len(calls), threading.Barrier(len(calls))

    def run(i):
        gate.wait()
        try:
            calls[i]()
        except Exception as e:  # noqa: BLE001
            out[i] = e

    threads = [threading.Thread(target=run, args=(i,)) for i in range(len(calls))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    return out


def test_of_two_moves_at_once_one_wins(spark, tmp_path):
    path = f"file://{tmp_path}/subs"
    rows = lambda *ids: spark.createDataFrame([(i, "me", "2026", "t", None, "{}") for i in ids], COLUMNS)
    Submissions(spark, path).add(rows("a", "b", "c"))
    said = at_once(*[lambda note=n: Submissions(spark, path).move("a", "validated", note) for n in "xyz"])
    assert sorted(type(e).__name__ for e in said) == ["NoneType", "ValueError", "ValueError"]
    winner = "xyz"[said.index(None)]
    got = {r.id: (r.status, r.review_note, r.version) for r in Submissions(spark, path).list().collect()}
    assert got == {"a": ("validated", winner, 1), "b": ("pending", None, 0), "c": ("pending", None, 0)}
    # changes that don't touch each other both come through, by another try
    assert at_once(lambda: Submissions(spark, path).move("b", "rejected"), lambda: Submissions(spark, path).move("c", "validated"), lambda: Submissions(spark, path).add(rows("d"))) == [None] * 3
    assert {r.id: r.status for r in Submissions(spark, path).list().collect()} == {"a": "validated", "b": "rejected", "c": "validated", "d": "pending"}
    # the same new id twice: one of them is known
    assert sorted(type(e).__name__ for e in at_once(*[lambda: Submissions(spark, path).add(rows("e"))] * 2)) == ["NoneType", "ValueError"]
    assert sorted(p.name for p in (tmp_path / "subs/log").iterdir() if not p.name.startswith(".")) == [f"{i:012d}.json" for i in range(6)]


def test_the_log_is_compacted(spark, tmp_path):
    s = Submissions(spark, f"file://{tmp_path}/subs", compact_every=3)
    s.add(spark.createDataFrame([("a", "me", "2026", "t", None, "{}")], COLUMNS))
    for state in ("validated", "approved", "merged"):
        s.move("a", state)
    assert [c["whole"] for _, c in s._commits()] == [True, False]
    assert [(r.status, r.version) for r in s.list().collect()] == [("merged", 3)]
    with pytest.raises(KeyError):
        s.move("zz", "validated")


def test_put_if_absent(spark, tmp_path):
    path = f"file://{tmp_path}/one/x.json"
    said = []
    at_once(*[lambda i=i: said.append(put_if_absent(spark, path, str(i))) for i in range(8)])
    assert sorted(said) == [False] * 7 + [True]
    assert (tmp_path / "one/x.json").read_text() in "01234567" and not [p for p in (tmp_path / "one").iterdir() if p.name != "x.json"]
