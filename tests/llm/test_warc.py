import random

import pytest
import zstandard

from cellwise.llm import warc
from cellwise.llm.store import new_path

SCHEMA = "page_id long, url string, html string, payload string, digest int"


def pages():
    rng = random.Random(0)
    body = lambda: "<p>" + " ".join(rng.choices(["alpha", "beta", "größe", "😀"], k=200)) + "</p>"
    rows = [(i, f"http://x/{i}", body()) for i in range(300)]
    rows += [(400 + i, f"http://y/{i}", rows[i % 7][2]) for i in range(50)]
    rows += [(500, None, None), (501, "u\r\nWARC-Type: evil%0A%25", ""), (503, "http://x/%0D%0A%25", ""), (None, "http://n/", rows[0][2]), (None, "http://n/", None), (0, "http://x/0", rows[0][2]), (502, "http://long/", "x" * 3_000_000)]
    return rows


@pytest.mark.parametrize("options", [{}, {"file_bytes": 5000, "sample_bytes": 20_000, "dictionary_bytes": 2048}, {"least_bytes": 1}])
def test_round_trip(spark, options):
    rows = pages()
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    found = warc.round_trip(frame, **options).collect()
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    wanted = []
    for page, url, html in rows:
        data = (html or "").encode()
        again = page is not None and page != first[html or ""] and len(data) >= options.get("least_bytes", 0)
        wanted.append((page, url, len(data), warc.digest(data), "revisit" if again else "response", first[html or ""] if again else None))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, wanted))
    assert warc.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_files_are_whole_and_carry_their_dictionary(spark):
    frame = spark.createDataFrame([(*r, "clash", 1) for r in pages()], SCHEMA).repartition(2)
    path = new_path(spark, "warc-test")
    listed = warc.write(frame, path).collect()
    files = spark.read.format("binaryFile").load(path).collect()
    assert sorted(f.path.rsplit("/", 1)[1] for f in files) == sorted(r.file.rsplit("/", 1)[1] for r in listed)
    assert sum(r.records for r in listed) == len(pages())
    data = max((bytes(f.content) for f in files), key=len)
    assert data[:4] == bytes.fromhex("5d2a4d18") and int.from_bytes(data[4:8], "little") > 1000
    records = list(warc.read_archive(data))
    assert all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in records)
    with pytest.raises(zstandard.ZstdError):  # the frames need the dictionary
        zstandard.ZstdDecompressor().decompress(data[8 + int.from_bytes(data[4:8], "little") :])
    with pytest.raises(ValueError):
        warc.parse(max(records, key=len).replace(b"alpha", b"ALPHA", 1) if b"alpha" in max(records, key=len) else max(records, key=len).replace(b"xxx", b"yyy", 1))


def test_nothing(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
