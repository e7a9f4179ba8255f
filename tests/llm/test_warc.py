"""Archives: exact round trips, foreign and damaged files, and the query's own records by hand."""

import hashlib
import os
import struct

import pytest
import zstandard

from maskline.llm import warc

KIND = "page_id long, url string, html string, digest string, first long, value string"
LONG = "<p>Zeile für Zeile</p>" * 20


def pages(spark, rows):
    return spark.createDataFrame([(p, u, h, "x", 1, "y") for p, u, h in rows], KIND)


def by_hand(rows):
    out, firsts = [], {}
    for p, _, h in rows:
        h = h or ""
        if len(h.encode()) >= 100 and p is not None:
            firsts[h] = min(p, firsts.get(h, p))
    for p, _, h in rows:
        h = h or ""
        first = firsts.get(h)
        revisit = first is not None and p != first
        out.append((p, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "revisit" if revisit else "response", first if revisit else None, None))
    return sorted(out, key=repr)


ROWS = [(i, f"http://a.example/{i % 3}?q=ü {i}\n", f"{LONG}{i % 4}") for i in range(30, 0, -1)] + [(None, None, LONG + "1"), (50, "", None), (51, None, ""), (52, "u", "short"), (53, "u", "short"), (7, "again", f"{LONG}{7 % 4}"), (1, "again", f"{LONG}1"), (None, "x", "only null" * 30), (60, "u", "ä\r\n\r\n\x00" * 400_000), (61, "v", "ä\r\n\r\n\x00" * 400_000)]


@pytest.mark.parametrize("rows_an_archive", [1, 32])
def test_round_trip(spark, tmp_path, rows_an_archive, monkeypatch):
    path = f"{tmp_path}/archives"
    warc.write(pages(spark, ROWS).repartition(3), path, rows=rows_an_archive)
    found = warc.resolved(warc.read(spark, path)).filter("record_type <> 'warcinfo'").collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["problem"]) for r in found), key=repr) == by_hand(ROWS)
    whole = {(p, hashlib.sha256((h or "").encode()).hexdigest()): (h or "").encode() for p, _, h in ROWS}
    assert all(bytes(r["payload"]) == whole[r["page_id"], r["payload_digest"]] for r in found if r["record_type"] == "response")
    assert all(r["payload"] is None for r in found if r["record_type"] == "revisit")


def test_no_pages(spark, tmp_path):
    warc.write(pages(spark, []), f"{tmp_path}/none")
    assert warc.read(spark, f"{tmp_path}/none").collect() == []


def sample(n=400):
    return [f"<html><body><h1>Title {i}</h1><p>{'words of a page ' * (i % 7 + 1)}{i * i}</p></body></html>".encode() for i in range(n)]


def archive(payloads, dictionary=None, packed=False, content_size=True):
    d = zstandard.train_dictionary(4096, sample()) if dictionary is None else dictionary
    packer = zstandard.ZstdCompressor(dict_data=d or None, write_content_size=content_size)
    held = d.as_bytes() if d else b""
    held = zstandard.compress(held) if packed else held
    out = struct.pack("<II", warc.DICTIONARY_FRAME, len(held)) + held if d else b""
    return out, [packer.compress(warc.page_record(i, "http://x", p, hashlib.sha256(p).hexdigest(), None, "2020-01-01T00:00:00Z")) for i, p in enumerate(payloads)]


def read(data):
    return [(r["page_id"], r["payload"], r["problem"]) for r in warc.records(memoryview(data))]


@pytest.mark.parametrize("how", [{}, {"packed": True}, {"dictionary": False}, {"content_size": False}])
def test_forms_of_archives(how):
    """A dictionary as it is, compressed, none; frames that don't tell their size; skippable frames between."""
    payloads = [*sample(5), b"", os.urandom(300_000), b"a" * 2_000_000]
    lead, frames = archive(payloads, **how)
    between = struct.pack("<II", warc.SKIPPABLE + 3, 5) + b"12345"
    assert read(lead + between.join(frames) + warc.EMPTY) == [(i, p, None) for i, p in enumerate(payloads)]


def test_every_frame_ends_where_it_says():
    _, frames = archive([*sample(5), os.urandom(300_000), b"a" * 500_000])
    data = memoryview(b"".join(frames))
    at, ends = 0, []
    while at < len(data):
        at = warc.frame_end(data, at)
        ends.append(at)
    assert ends == [sum(map(len, frames[: i + 1])) for i in range(len(frames))]


def test_damage_is_told_and_the_rest_is_read():
    payloads = sample(4)
    lead, frames = archive(payloads)
    packer = zstandard.ZstdCompressor(dict_data=zstandard.train_dictionary(4096, sample()))

    def with_record(text):
        return read(lead + frames[0] + packer.compress(text) + frames[1])

    good = warc.page_record(9, "http://x", b"payload", hashlib.sha256(b"payload").hexdigest(), None, "2020")
    for bad, told in [
        (good.replace(b"WARC/1.1", b"WARC/7"), "no WARC header"), (good.replace(b"payload\r\n", b"payloaf\r\n"), "block digest"), (good[:-1], "length"), (good + b"x", "length"),
        (good.replace(b"WARC-Date", b"WARC-Dote"), "no warc-date"), (good.replace(b"WARC-Date: 2020", b"WARC-Date: 2020\r\nbroken"), "header line without a name"),
        (warc.page_record(9, "u", b"payload", "0" * 64, None, "2020"), "payload digest"), (b"", "no WARC header"),
    ]:
        first, damaged, last = with_record(bad)
        assert (first[1], last[1]) == (payloads[0], payloads[1]) and damaged[2].endswith(told), (told, damaged)
    for cut in (lead + frames[0] + frames[1][:-3], lead + frames[0] + b"no frame at all", lead + frames[0] + b"abc"):
        rows = read(cut)
        assert rows[0][1] == payloads[0] and len(rows) == 2 and rows[1][2]
    assert "dictionary" in read(struct.pack("<II", warc.DICTIONARY_FRAME, 4) + b"none")[0][2]
    assert read(b"") == []


def test_revisits_must_refer(spark):
    row = {n: None for n in warc.NAMES} | {"record_type": "revisit", "record_id": "b", "refers_to_id": "a", "page_id": 2, "payload_bytes": 5, "payload_digest": "d"}
    first = row | {"record_type": "response", "record_id": "a", "refers_to_id": None, "page_id": 1}
    for there, problem in (([first], None), ([], "no such response"), ([first | {"payload_digest": "e"}], "no such response"), ([first | {"payload_bytes": 6}], "no such response")):
        df = spark.createDataFrame([tuple(r[n] for n in warc.NAMES) for r in [row, *there]], warc.RECORD)
        assert [r["problem"] for r in warc.resolved(df).filter("record_type = 'revisit'").collect()] == [problem]
