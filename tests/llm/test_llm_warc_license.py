import hashlib
import io
import random
import struct
from datetime import datetime, timezone
from difflib import SequenceMatcher

import pytest
import zstandard
from pyarrow import fs

from ledgerwatch.llm import license_scan as L, warc_zst as W
from ledgerwatch.llm.common import file_system, shared_folder
from ledgerwatch.session import materialise


def pages(n=300, seed=1):
    rnd = random.Random(seed)
    bodies = [f"<html><body><p>{' '.join(rnd.choice(['alpha', 'beta', 'gamma']) for _ in range(rnd.randrange(200)))}</p></body></html>" for _ in range(n // 3)]
    return [(i, f"https://x.org/{i}", rnd.choice(bodies)) for i in range(n)]


def plain_records(rows):
    """Digest, length, type and the page referred to, by a dictionary of payloads."""
    first = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 100 and i is not None:
            first[raw] = min(first.get(raw, i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        refers = first[raw] if raw in first and i is not None and first[raw] < i else None
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    return out


def test_round_trip(spark):
    rows = pages() + [(500, None, None), (501, "u", ""), (502, "a\nb%\r", "x" * 99), (503, "u", "x" * 99), (None, "n", "y" * 200), (504, "u", "y" * 200),
                      (505, "u", "y" * 200), (5, "again", None), (600, "long", "é" * 400_000), (601, "long", "é" * 400_000), (505, "u", "y" * 200)]
    df = spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, refers_to int, digest string").repartition(4)
    folder = shared_folder(spark, "test-warc")
    manifest = materialise(W.write(df, "page_id", "url", "html", folder), "test-warc")
    got = W.read(spark, folder, manifest).collect()
    assert sorted(map(str, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(str, plain_records(rows)))
    texts = sorted((r.page_id, bytes(r.payload).decode()) for r in got if r.record_type == "response" and r.page_id is not None)
    assert texts == sorted((i, h or "") for (i, _, h), p in zip(rows, plain_records(rows)) if p[3] == "response" and i is not None)
    assert all(bytes(r.payload) == b"" for r in got if r.record_type == "revisit")
    assert {r.url for r in got if r.page_id == 502} == {"a\nb%\r"}
    assert W.round_trip(df.limit(0), "page_id", "url", "html").count() == 0


def test_archive_format():
    records = [W.record(i, f"u{i}", hashlib.sha256(b"p").hexdigest(), 1, None, b"p" + bytes(str(i) * 300, "ascii"))[:-4] + b"\r\n\r\n" for i in range(100)]
    out = io.BytesIO()
    n, plain, stored = W.write_archive(out, iter(records))
    raw = out.getvalue()
    magic, size = struct.unpack("<II", raw[:8])
    assert (n, plain, stored, magic) == (100, sum(map(len, records)), len(raw), 0x184D2A5D)
    known = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
    first = zstandard.ZstdDecompressor(dict_data=known).decompressobj()
    assert first.decompress(raw[8 + size :]) == records[0]  # a frame for each record
    assert list(W.read_archive(io.BytesIO(raw))) == records
    plainly = sum(len(zstandard.ZstdCompressor(level=W.LEVEL).compress(r)) for r in records)
    assert len(raw) - size < plainly  # the dictionary saves bytes in each record


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_records_have_an_empty_dictionary(n):
    out = io.BytesIO()
    W.write_archive(out, iter([b"abc"] * n))
    assert list(W.read_archive(io.BytesIO(out.getvalue()))) == [b"abc"] * n


def test_sample_is_bounded(monkeypatch):
    monkeypatch.setattr(W, "SAMPLE_RECORDS", 20)
    records = [b"record %d " % i + b"same words again and again " * 20 for i in range(300)]
    out = io.BytesIO()
    assert W.write_archive(out, iter(records))[0] == 300
    assert list(W.read_archive(io.BytesIO(out.getvalue()))) == records


def test_damage_is_noticed():
    out = io.BytesIO()
    good = W.record(1, "u", hashlib.sha256(b"body").hexdigest(), 4, None, b"body")
    assert W.parsed(good)["payload"] == b"body"
    with pytest.raises(ValueError):
        W.parsed(good.replace(b"body", b"bodx"))
    W.write_archive(out, iter([good] * 5))
    with pytest.raises(ValueError):
        list(W.read_archive(io.BytesIO(out.getvalue()[:-3])))


def test_two_attempts_do_not_clash(spark, tmp_path):
    df = spark.createDataFrame(pages(30), "page_id long, url string, html string").coalesce(1)
    system, inner = fs.LocalFileSystem(), str(tmp_path)
    first = W.write(df, "page_id", "url", "html", f"file://{inner}")
    one, two = materialise(first, "one"), materialise(first, "two")  # the same tasks twice
    assert len(system.get_file_info(fs.FileSelector(inner))) == 2
    for manifest in (one, two):
        assert W.read(spark, f"file://{inner}", manifest, payloads=False).count() == 30


def test_archives_roll_and_records_follow_the_standard(spark):
    rows = pages(200) + [(7, "again", None), (7, "again", None), (None, "n", "y" * 200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    folder = shared_folder(spark, "test-warc-roll")
    when = datetime(2024, 5, 6, 7, 8, 9, tzinfo=timezone.utc)
    W_SAMPLE, W.SAMPLE_RECORDS = W.SAMPLE_RECORDS, 10
    try:
        manifest = materialise(W.write(df, "page_id", "url", "html", folder, when, archive_bytes=4000), "test-warc-roll")
    finally:
        W.SAMPLE_RECORDS = W_SAMPLE
    names = [r.name for r in manifest.collect()]
    assert len(names) > 3 and sum(r.records for r in manifest.collect()) == len(rows)
    got = W.read(spark, folder, manifest, payloads=False).collect()
    assert sorted(map(str, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(str, plain_records(rows)))
    url_of, ids = {i: u for i, u, _ in rows}, []
    system, inner = file_system(folder)
    for name in names:
        with system.open_input_stream(f"{inner}/{name}") as stream:
            for raw in W.read_archive(stream):
                head, _, rest = raw.partition(b"\r\n\r\n")
                first, *lines = head.decode().split("\r\n")
                fields = dict(x.split(": ", 1) for x in lines)
                assert first == "WARC/1.1" and len(fields) == len(lines)
                ids.append(fields["WARC-Record-ID"])
                assert fields["WARC-Date"] == "2024-05-06T07:08:09Z" and ids[-1].startswith("<urn:uuid:")
                assert fields["Content-Type"] == "application/http;msgtype=response" and rest.startswith(b"HTTP/1.1 200 OK\r\n")
                assert len(rest) == int(fields["Content-Length"]) + 4 and rest.endswith(b"\r\n\r\n")
                if fields["WARC-Type"] == "revisit":
                    assert fields["WARC-Refers-To-Target-URI"] == url_of[int(fields["X-Refers-To-Page-ID"])]
                    assert fields["WARC-Refers-To-Date"] == fields["WARC-Date"] and fields["WARC-Profile"] == W.PROFILE
    assert len(set(ids)) == len(rows)  # also of pages that come twice or without an id


def test_payload_of_many_pages_is_dealt_over_slices(spark):
    rows = [(i, f"u{i}", "z" * 150) for i in range(100)] + [(100 + i, f"u{i}", f"{i % 5}" * 120) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.refers_to, r.refers_url) for r in W.revisits(df, "page_id", "url", "html", hot_rows=7).collect()}
    want = {(i, r, f"u{r if r < 100 else r - 100}") for i, _, _, kind, r in plain_records(rows) if kind == "revisit"}
    assert got == want and len(want) == 99 + 15


# License notices.

def plain_scan(line):
    """Every template against a line by wording alone."""
    found = []
    have = [m[0].lower() for m in L._words(line)]
    for name, text in L.TEMPLATES.items():
        want = [m[0].lower() for m in L._words(text)]
        same = [m for m in SequenceMatcher(None, have, want, autojunk=False).get_matching_blocks() if m.size]
        if same:
            kept = sum(m.size for m in same)
            off = len(want) - kept + (same[-1].a + same[-1].size - same[0].a) - kept
            if off <= L.MOST_CHANGED * len(want):
                found.append((off, -len(want), name))
    return min(found)[2] if found else None


@pytest.mark.parametrize("name", sorted(L.TEMPLATES))
def test_every_template_is_found(name):
    scanner = L.Scanner(L.TEMPLATES)
    text = "Some words before.\n" + L.TEMPLATES[name] + "\nand after."
    got = scanner.scan(text)
    assert [g[0] for g in got] == [name] and got[0][1:3] == (0, 0)
    a, b = got[0][3:5]
    assert [m[0] for m in L._words(text[a:b])] == [m[0] for m in L._words(L.TEMPLATES[name])]


def test_changed_wording():
    scanner = L.Scanner(L.TEMPLATES)
    (got,) = scanner.scan("x\nThis work is hereby licensed under the GNU General Public License, version 3!")
    assert got[0] == "GPL-3.0" and got[1:3] == (0, 1)
    assert scanner.scan("under the tree; no license to speak of here") == []
    assert scanner.scan("LICENSED  UNDER cc by-nc 4.0.")[0][0] == "CC-BY-NC-4.0"
    wrapped = L.TEMPLATES["MIT-grant"].split()
    assert scanner.scan("\n".join(" ".join(wrapped[i : i + 9]) for i in range(0, len(wrapped), 9)))[0][0] == "MIT-grant"


@pytest.mark.parametrize("name", sorted(L.TEMPLATES))
def test_wrapped_anywhere(name):
    """Broken at any word, behind a notice or sixty other words of the line, with comment marks."""
    scanner, words = L.Scanner(L.TEMPLATES), L.TEMPLATES[name].split()
    for i in range(1, len(words)):
        for begin, mark in (("", ""), ("All rights reserved. ", ""), ("word " * 61, ""), ("x\n// ", "// ")):
            text = f"{begin}{' '.join(words[:i])}\n{mark}{' '.join(words[i:])}\n\nafter"
            got = [g[:3] for g in scanner.scan(text)]
            assert got[-1] == (name, 0, 0) and len(got) == 1 + begin.startswith("All"), text


def test_every_notice_of_a_block():
    scanner = L.Scanner(L.TEMPLATES)
    got = scanner.scan("Code is Released under the MIT License, texts are Licensed under CC BY 4.0.")
    assert [g[:3] for g in got] == [("MIT", 0, 0), ("CC-BY-4.0", 0, 0)]
    got = scanner.scan(" / ".join(t.rstrip(".:") for t in L.TEMPLATES.values()))
    assert [g[:3] for g in got] == [(name, 0, 0) for name in L.TEMPLATES]
    got = scanner.scan("Released under the MIT License, " * 300)
    assert [g[0] for g in got] == ["MIT"] * 300 and all(a[4] <= b[3] for a, b in zip(got, got[1:]))


def test_words_of_a_template_near_a_changed_notice():
    text = "Version 2.0 of the Apache License, Version 2.0, and so on; now Licensed under Apache License, Version 2.0."
    (got,) = L.Scanner(L.TEMPLATES).scan(text)
    assert got[:3] == ("Apache-2.0", 1, 0) and text[got[3]:].startswith("Licensed under")


def test_templates_save_bytes():
    scanner = L.Scanner(L.TEMPLATES)
    saved, name, alone, given = scanner.savings("Licensed under the Apache License, Version 2.0.")[0]
    assert name.startswith("Apache") and saved == alone - given > 0.5 * alone


def test_compression_decides(monkeypatch):
    """Without the savings another template wins, and what merely shares words passes or fails otherwise."""
    text = L.TEMPLATES["Apache-2.0-header"]
    assert [g[0] for g in L.Scanner(L.TEMPLATES).scan(text)] == ["Apache-2.0-header"]
    plain = L.Scanner.savings
    monkeypatch.setattr(L.Scanner, "savings", lambda self, block: sorted((9, k, a, n) for _, k, a, n in plain(self, block)))
    assert [g[0] for g in L.Scanner(L.TEMPLATES).scan(text)] != ["Apache-2.0-header"]
    monkeypatch.setattr(L.Scanner, "savings", lambda self, block: sorted((0, k, a, n) for _, k, a, n in plain(self, block)))
    assert L.Scanner(L.TEMPLATES).scan(text) == []


def test_given_templates_and_changed_notices():
    """Templates of the caller are found by their own words; changed, wrapped and nested notices with a recall of 0.9 and more."""
    own = {"own": "Confidential property of the author, do not copy or share.", "other": "Anyone may use these recipes for whatever they like, at home or in public kitchens."}
    text = "x\n# Confidential property of the author,\n# do not copy or share.\n\ny"
    assert [g[:3] for g in L.Scanner(own).scan(text)] == [("own", 0, 0)]
    assert L.Scanner({}).scan(text) == [] == L.Scanner(L.TEMPLATES).scan("a property of the author")
    rnd, hits, n, wrong = random.Random(5), 0, 0, 0
    templates = {k: t for k, t in (L.TEMPLATES | own).items() if len(L.Scanner({k: t}).words[k]) >= 8}
    scanner = L.Scanner(templates)
    for name in templates:
        for _ in range(25):
            words = templates[name].split()
            for _ in range(rnd.randrange(1, max(2, scanner.most[name] // 2 + 1))):
                at = rnd.randrange(len(words))
                words[at : at + rnd.choice((0, 1))] = rnd.choice(([], ["indeed"]))
            body, gap = "", 0
            for w in words:  # wrapped, with marks of a comment
                gap = rnd.randrange(9)
                body += w + (" " if gap else "\n * ")
            filler = " ".join(f"word{rnd.randrange(99)}" for _ in range(rnd.randrange(80)))
            found = [g[0] for g in scanner.scan(f"{filler}\n{body}, {filler}")]
            n, hits, wrong = n + 1, hits + (name in found), wrong + any(f != name and not f.startswith(("GPL", "LGPL", "AGPL", "Apache")) for f in found)
    assert hits >= 0.9 * n and wrong <= 0.02 * n


def test_documents_against_wording_alone(spark):
    from ledgerwatch.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    want = sorted((d.doc_id, plain_scan(line)) for d in docs for line in (d.text or "").split("\n")
                  if len(line.split()) < 30 and plain_scan(line))
    got = sorted((r.doc_id, r.license) for r in QUERIES["op3_license_scan"](spark, "/root/testdata/sf0.01").collect())
    assert got == want and len(got) > 20


def test_odd_rows(spark):
    rows = [(1, "All rights reserved."), (1, "All rights reserved."), (None, "Released under the MIT License."), (2, None), (3, ""), (4, "word " * 50_000 + "\nAll rights reserved.")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = sorted(((r.id, r.license) for r in L.scan(df, "doc_id", "text").collect()), key=str)
    assert got == sorted([(1, "all-rights-reserved"), (1, "all-rights-reserved"), (4, "all-rights-reserved"), (None, "MIT")], key=str)
    assert L.scan(df.limit(0), "doc_id", "text").count() == 0
