"""Hard negatives, WARC archives and spelling variants: brute-force versions and edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from skyledger.llm import negatives, spelling, warc
from skyledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SPACES = "vec_id long, embedding array<double>, label int"

# ---------------------------------------------------------------- hard negatives


def mined(data, every, positives=5, count=3, low=50, high=95):
    """The contract, row by row, in Python integers."""
    rows = []
    for at, (ident, vector, label, *_) in enumerate(data):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        q = [math.floor(256 * x) for x in vector]
        if sum(x * x for x in q) < 1 << 62:
            rows.append((ident, q, label, at))

    def key(score, row):
        return (-score, row[0] is None, row[0] or 0, row[3])

    out = Counter()
    for a in rows:
        if a[0] is None or a[0] % every:
            continue
        scores = [(sum(x * y for x, y in zip(a[1], b[1], strict=True)), b) for b in rows if len(a[1]) == len(b[1])]
        same = sorted((s for s in scores if s[1][2] == a[2] and s[1][3] != a[3]), key=lambda s: key(*s))
        for p, positive in same[:positives]:
            fit = [s for s in scores if s[1][2] != a[2] and low * p <= 100 * s[0] <= high * p]
            for rank, (n, negative) in enumerate(sorted(fit, key=lambda s: key(*s))[:count], 1):
                out[(a[0], positive[0], rank, negative[0], p, n)] += 1
    return out


def spark_mined(spark, data, every, ddl=SPACES, **options):
    found = negatives.mine(spark.createDataFrame(data, ddl), F.col("vec_id") % every == 0, **options)
    assert found.columns == [
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    ]
    return Counter(tuple(r) for r in found.collect())


def cloud(seed, n, dim=8, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    x = centres[rng.integers(0, 6, n)] + 0.4 * rng.standard_normal((n, dim))
    x *= rng.choice([0.2, 1.0, 1.0, 3.0], n)[:, None]
    return [(i, [float(v) for v in x[i]], int(rng.integers(0, labels))) for i in range(n)]


def test_negatives_equal_brute_force_in_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(negatives, "TILE", 60)
    monkeypatch.setattr(negatives, "BUCKET", 16)
    data = cloud(1, 400)
    assert spark_mined(spark, data, 4) == mined(data, 4)
    assert spark_mined(spark, data, 3, positives=2, negatives=4, low=10, high=60) == mined(data, 3, 2, 4, 10, 60)


def test_negatives_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BUCKET", 16)
    base = [
        (0, [1.0, 0.5], 1), (2, [1.0, 0.5], 1), (4, [0.0, 0.0], 1), (6, [0.0, 0.0], 2), (8, None, 1),
        (10, [1.0, None], 1), (12, [1.0, float("nan")], 1), (14, [float("inf"), 1.0], 1), (16, [1.0, 0.5], None),
        (18, [], 1), (20, [], 2), (22, [1.0], 1), (24, [0.9, 0.2], 2), (24, [0.8, 0.4], 2), (None, [0.8, 0.4], 2),
        (None, [0.9, 0.6], 1), (26, [1e300, 0.0], 2), (28, [-1.0, -0.5], 1), (30, [5e5, 5e5], 3), (32, [4e5, 1.0], 4),
        (34, [4e5, 5e5], 3), (36, [3e6, 3e6], 5), (38, [2.5e6, 3e6], 5), (40, [2e6, 2e6], 6),
    ]
    assert spark_mined(spark, base, 2) == mined(base, 2)
    twice = base + base
    assert spark_mined(spark, twice, 2) == mined(twice, 2)
    assert not spark_mined(spark, [], 2)
    wide = [(i, v, x, i, "c") for i, v, x in base]
    assert spark_mined(spark, wide, 2, SPACES + ", row long, grp string") == mined(base, 2)


def test_negatives_with_many_copies(spark, monkeypatch):
    monkeypatch.setattr(negatives, "TILE", 50)
    data = cloud(2, 120)
    hot = [(1000 + 2 * i, data[3][1], data[3][2]) for i in range(150)]
    hot += [(2000 + 2 * i, [0.5] * 8, (data[3][2] + 1) % 3) for i in range(150)]
    assert spark_mined(spark, data + hot, 10) == mined(data + hot, 10)


def test_ranges_lose_no_vector_and_spare_work():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16))
    x = centres[rng.integers(0, 40, 4000)] + 0.05 * rng.standard_normal((4000, 16))
    ints = np.floor(256 * x).astype(np.int32)
    ints = ints[np.argsort(-np.linalg.norm(ints, axis=1), kind="stable")]
    q = ints[::100]
    truth = q.astype(np.int64) @ ints.T.astype(np.int64)
    lo = np.sort(truth, axis=1)[:, -10][:, None].copy()
    search = negatives.Search(q, lo.copy(), np.full((len(q), 1), negatives.NEVER), None, 10)
    none = np.zeros(len(ints), dtype=np.int64)
    for s in range(0, len(ints), 500):
        rows = np.arange(s, s + 500)
        search.meet(negatives.Bucket(ints[rows]), none[rows], (none[rows], rows, rows))
    slot, score = search.best[:2]
    for i in range(len(q)):
        assert sorted(score[slot == i]) == sorted(np.sort(truth[i])[-10:])
    assert search.verified < 0.25 * truth.size


# ---------------------------------------------------------------- WARC


def test_warc_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r for r in QUERIES["op12_warc"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        payload = (r["html"] or "").encode()
        assert got[r["page_id"]]["payload_bytes"] == len(payload)
        assert got[r["page_id"]]["payload_digest"] == hashlib.sha1(payload).hexdigest()


def test_warc_revisits_and_odd_pages(spark, tmp_path):
    long, edge = "é" * 600, "x" * 1000
    data = [
        (1, "http://a.example/x y\r\nEvil: 1", long, 9), (7, "http://a.example/", long, 9), (3, None, long, 9),
        (5, "u", edge, 9), (6, "u", edge, 9), (8, "u", edge[:-1], 9), (9, "u", edge[:-1], 9), (10, "u", None, 9),
        (11, "u", "", 9), (None, "u", long, 9), (12, "u", "z" * 2000, 9), (12, "u", "z" * 2000, 9), (None, None, None, 9),
        (13, "u", "\r\n\r\nWARC/1.1\r\n" * 200, 9), (14, "u", "y" * 3_000_000, 9),
    ]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, payload long")
    path = f"file://{tmp_path}/archive"
    found = warc.round_trip(pages, path).collect()
    got = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in found)
    assert got == Counter(
        [
            (1, "revisit", 7, 1200), (7, "response", None, 1200), (3, "revisit", 7, 1200), (None, "revisit", 7, 1200),
            (5, "revisit", 6, 1000), (6, "response", None, 1000), (8, "response", None, 999),
            (9, "response", None, 999), (10, "response", None, 0), (11, "response", None, 0),
            (12, "response", None, 2000), (12, "revisit", 12, 2000), (None, "response", None, 0),
            (13, "response", None, 2800), (14, "response", None, 3_000_000),
        ]
    )
    texts = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in found:
        if r["page_id"] is not None:
            assert r["payload_digest"] == hashlib.sha1((texts[r["page_id"]] or "").encode()).hexdigest()
    back = warc.read(spark, path)
    by_page = {r["record_id"]: r for r in back.where("record_type <> 'warcinfo'").collect()}
    assert len(by_page) == len(data)
    for r in by_page.values():
        page = int(r["record_id"].split(":")[2] or -1)
        if r["record_type"] == "response" and page >= 0:
            assert bytes(r["payload"]).decode() == (texts[page] or "")
        assert r["http_status"] == 200
    first = next(r for k, r in by_page.items() if k.startswith("urn:page:1:"))
    assert first["target_uri"] == "http://a.example/x%20y%0D%0AEvil:%201" and "evil" not in first["headers"]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_filters_are_pushed_and_unwanted_payloads_stay_packed(spark, tmp_path, rows):
    data = [(i, f"http://h{i % 3}.example/{i}", chr(97 + i) * 3000) for i in range(6)]
    data += [(10 + i, "u", data[i][2]) for i in range(3)]
    path = f"file://{tmp_path}/archive"
    warc.archive(rows(data, "page_id long, url string, html string").coalesce(1), path)
    again = warc.read(spark, path, ["record_id", "payload_bytes"]).count()
    assert again == 10  # one is the record about the file
    picked = warc.read(spark, path).where("record_type = 'response' AND target_uri LIKE 'http://h1%' AND content_length > 10")
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan  # the source has taken all of it
    assert picked.count() == 1  # page 4; page 1 is a revisit now
    # spoil the packed payload of every response: who wants only revisits never inflates them
    for file in Path(tmp_path, "archive").glob("*.warc.gz"):
        raw, at = bytearray(file.read_bytes()), 0
        while at < len(raw):
            whole, size = warc.struct.unpack_from("<II", raw, at + 16)
            if size > 3000:
                raw[at + whole - 12 : at + whole - 8] = b"\xff" * 4
            at += whole
        file.write_bytes(raw)
    assert len(warc.read(spark, path).where("record_type = 'revisit'").collect()) == 3
    with pytest.raises(PythonException):
        warc.read(spark, path, ["record_id", "record_type", "payload"]).where("record_type = 'response'").collect()


def reading(data: bytes, columns, *wanted):
    import io

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    reader = warc.Reader.__new__(warc.Reader)
    reader.columns, reader.wanted = columns, list(wanted)
    stream = warc.Stream(Source(data), "x")
    return list(reader.records(stream)), stream


def foreign(pieces, packed: bool):
    import gzip

    raw = [b"".join(p) for p in pieces]
    return b"".join(gzip.compress(r) for r in raw) if packed else b"".join(raw)


@pytest.mark.parametrize("packed", [True, False])
def test_warc_of_others(packed):
    body = bytes(range(256)) * 900
    http = b"HTTP/1.1 404 Not Found\r\nX: 1\r\n\r\n"
    pieces = [
        warc.record("warcinfo", "a", {"Content-Type": "x"}, [b"k: v\r\n"]),
        warc.record("response", "b", {"Content-Type": warc.HTTP, "X-Own": "1\r\n 2"}, [http, body]),
        warc.record("resource", "c", {"Content-Type": "text/plain"}, [b"\r\n\r\nhello"]),
        warc.record("response", "d", {"Content-Type": warc.HTTP}, [http]),
    ]
    data = foreign(pieces, packed)
    found, _ = reading(data, list(warc.TYPES))
    assert [r["record_id"] for r in found] == ["a", "b", "c", "d"]
    assert found[1]["payload"] == body and found[1]["http_status"] == 404
    assert dict(found[1]["headers"])["x-own"] == "1 2"
    assert found[2]["payload"] == b"\r\n\r\nhello" and found[3]["payload"] == b""
    only, _ = reading(data, ["record_id"], ("EqualTo", "record_type", "resource"))
    assert [r["record_id"] for r in only] == ["c"]
    with pytest.raises(ValueError):
        reading(data[:-30], list(warc.TYPES))
    assert reading(b"", ["record_id"])[0] == []


def test_warc_skips_by_the_length_in_the_member():
    body = random.Random(3).randbytes(2_000_000)
    pieces = [warc.record("response", str(i), {"Content-Type": warc.HTTP}, [b"HTTP/1.1 200 OK\r\n\r\n", body]) for i in range(4)]
    data = b"".join(warc.member(p) for p in pieces)
    import gzip

    assert gzip.decompress(data) == b"".join(b"".join(p) for p in pieces)
    found, stream = reading(data, ["record_id"], ("EqualTo", "record_type", "revisit"))
    assert found == [] and stream.inflated < 400_000
    found, stream = reading(data, ["record_id", "payload"], ("In", "record_id", ("2",)))
    assert found[0]["payload"] == body and stream.inflated < 2_600_000


def test_warc_failed_attempts_do_not_count(spark, tmp_path, rows):
    path = tmp_path / "archive"
    pages = rows([(1, "u", "a")], "page_id long, url string, html string")
    warc.archive(pages, f"file://{path}")
    stray = next(path.glob("*.warc.gz"))
    (path / "part-of-a-lost-task.warc.gz").write_bytes(stray.read_bytes())
    assert warc.read(spark, f"file://{path}").where("record_type = 'response'").count() == 1
    warc.archive(pages, f"file://{path}")  # another commit adds to the archive
    assert warc.read(spark, f"file://{path}").where("record_type = 'response'").count() == 2


# ---------------------------------------------------------------- spelling variants


def brute_words(data):
    found = Counter()
    letters = {chr(c) for c in range(0xC0, 0x100)} | set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    for doc_id, text, *_ in data:
        run = ""
        for c in (text or "") + " ":
            if c in letters:
                run += c.lower() if "A" <= c <= "Z" else c
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % 31 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                found[run] += 1
                run = ""
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(data):
    words = brute_words(data)
    beside = {w: [] for w in words}
    by_cut = {}
    for w in words:  # words one edit apart share a string with one letter less, or are one
        for s in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            by_cut.setdefault(s, set()).add(w)
    for group in by_cut.values():
        for a in group:
            for b in group:
                if a != b and b not in beside[a] and near(a, b):
                    beside[a].append(b)
    form = {}
    for w, others in beside.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(beside[w]), words.get(form[w])) for w, n in words.items()}


def spark_variants(spark, data, ddl="doc_id long, text string"):
    found = spelling.variants(spark.createDataFrame(data, ddl)).collect()
    out = {tuple(r) for r in found}
    assert len(out) == len(found)
    return out


def test_variants_of_documents_equal_brute_force(spark):
    data = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in QUERIES["op13_spelling_variants"](spark, SF).collect()}
    want = brute_variants(data)
    assert len(want) > 500 and any(w[1] for w in want)
    assert got == want


def test_variants_in_tiles_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD", 40)
    monkeypatch.setattr(spelling, "BLOCK", 30)
    monkeypatch.setattr(spelling, "HELD", 50)
    rng = random.Random(4)
    bases = ["abcdefg", "abcdefgh", "zyxwvutsr", "ÀÉîõüÿß", "thethethe"]
    words = []
    for _ in range(900):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 1, 2])):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1])] = rng.choice(["", "a", "e", "é", "z"])
        words += ["".join(w)] * rng.choice([1, 2, 2, 3, 30])
    rng.shuffle(words)
    data = [(i, " ".join(words[i::20])) for i in range(20)]
    assert spark_variants(spark, data) == brute_variants(data)


def test_variants_of_odd_texts(spark):
    long = "ab" * 4000
    data = [
        (1, "colours COLOURS Colour's colour×s colours"), (1, "colours"), (None, "letters letters"),
        (None, None), (2, ""), (3, "ſhortest ſhortest İstanbul kelvinsK kelvins"),
        (4, f"{long} {long} {long[:-1]}c {long[:-1]}c"), (5, "short six sixsix sevenn7 ÀÀÀÀÀÀÀ àààààààà"),
        (6, " ".join(["neighbour"] * 40 + ["neighbor"] * 4 + ["nieghbor"] * 2)), (7, " ".join(["neighbours"] * 400)),
    ]
    want = brute_variants(data)
    assert spark_variants(spark, data) == want
    wide = [(i, t, 7, "x") for i, t in data]
    assert spark_variants(spark, wide, "doc_id long, text string, word long, n string") == want
    assert spark_variants(spark, data + data) == brute_variants(data + data)
    assert spark_variants(spark, []) == set()


def test_one_edit_against_all_pairs():
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.choice([7, 8]))) for _ in range(700)})
    codes = spelling.letter_codes(words, 8)
    queries = [i for i, w in enumerate(words) if len(w) == 7]
    i, j = spelling.one_edit(codes[queries, :7], codes, 7)
    got = {(words[queries[a]], words[b]) for a, b in zip(i, j, strict=True)}
    assert got == {(a, b) for a in words if len(a) == 7 for b in words if near(a, b)}
