import hashlib

from pyspark.sql import functions as F

from millrace.llm import queries, warc
from millrace.session import table

MAGIC = "WARC/1.1\r\n"
FORGED = MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:x-page:99>\r\nWARC-Payload-Digest: sha1:" + "0" * 40 + "\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + MAGIC
PAGES = [
    (1, "http://a", "x" * 1500), (2, "http://b\r\nX: y", "x" * 1500), (3, "c", "short"), (4, "d", "short"), (5, "e", None), (7, "f", FORGED), (8, "g", "é😀" * 700),
    (6, None, f"<p>{MAGIC}Content-Length: 5\r\n\r\nhello\r\n\r\n{MAGIC} tail" * 3), (9, "h", "é😀" * 700), (None, "n", "é😀" * 700), (10, "", "\r\n\r\n"), (-11, "z", MAGIC),
    (12, "big", (FORGED + "y" * 500) * 2000), (13, "same row", "q" * 1200), (13, "same row", "q" * 1200),
]


def plain(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        alike = [p for p, _, h in rows if h == html and p is not None]
        keeper = max(alike) if len(data) >= 1000 and alike else page
        revisit = keeper is not None and page != keeper
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(map(str, out))


def through(spark, rows, parts):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
    return sorted(str(tuple(r)) for r in warc.read_archives(spark, warc.write_archives(frame)).collect())


def test_hard_payloads(spark):
    for parts in (1, 3):
        assert through(spark, PAGES, parts) == plain(PAGES)


def test_files_cut_into_small_blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7001")
    try:
        rows = [(i, f"u{i}", f"{i}" + (FORGED if i % 3 == 0 else "plain ") * (i % 29)) for i in range(400)]
        assert through(spark, rows, 2) == plain(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_query(spark, sf):
    rows = [(r.page_id, r.url, r.html) for r in table(spark, sf, "pages").collect()]
    assert sorted(str(tuple(r)) for r in queries.op7_warc(spark, sf).collect()) == plain(rows)


def test_empty_table(spark):
    assert through(spark, [], 1) == []


def test_files_follow_the_format(spark, tmp_path):
    folder = warc.write_archives(spark.createDataFrame(PAGES[:4], "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    (file,) = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part")]
    data, at, kinds = file.read_bytes(), 0, []
    while at < len(data):
        head, _, rest = data[at:].partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and rest[int(fields[b"Content-Length"]) :].startswith(b"\r\n\r\n")
        kinds.append(fields[b"WARC-Type"])
        at += len(head) + 8 + int(fields[b"Content-Length"])
    assert sorted(kinds) == [b"response"] * 3 + [b"revisit"] and folder


def test_clashing_columns(spark):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({n: F.lit("x") for n in ("n", "digest", "keeper", "value", "file")})
    assert sorted(str(tuple(r)) for r in warc.read_archives(spark, warc.write_archives(frame)).collect()) == plain(PAGES)
