import base64
import hashlib
import random
import re

from llm_cases import LONG, SF_SMALL

from panelkit.llm import warc_salvage as W


def run(spark, tmp_path, rows, archive_bytes=W.ARCHIVE_BYTES):
    pages = spark.createDataFrame([(i, f"http://x/{i} y\r\n", h, 1, "z") for i, h in rows],
                                  "page_id long, url string, html string, id int, digest string")
    n = W.archive_count(pages, "html", archive_bytes)
    W.write_archives(W.plan_records(pages, "page_id", "url", "html", n), str(tmp_path / "a"))
    return W.read_archives(spark, str(tmp_path / "a")), n


def test_round_trip_and_types(spark, tmp_path):
    big, small = "é" * 60, "x" * 99
    rows = [(5, big), (2, big), (9, big), (1, small), (3, small), (4, None), (6, ""), (7, LONG), (8, "x" * 100),
            (10, "x" * 100), (None, big), (9, big)]
    df, n = run(spark, tmp_path, rows, archive_bytes=1000)
    assert n > 100
    got = df.collect()
    assert {r["kind"] for r in got} == {"record"} and len(got) == len(rows)
    first = {big: 2, "x" * 100: 8}
    for r in got:
        html = dict(rows)[r["record_id"]] or ""
        raw = html.encode()
        revisit = r["record_id"] is not None and len(raw) >= 100 and first.get(html, r["record_id"]) != r["record_id"]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == hashlib.sha256(raw).hexdigest()
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[html]) if revisit else ("response", None))
        assert revisit or bytes(r["payload"]) == raw


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, [])[0].count() == 0


def archive(n, packed):
    recs = [W.record_bytes(i, f"u{i}", (b"<p>%d</p>" % i) * (1 + i % 7 * 40), 1, "", "response", None) for i in range(n)]
    return [W.member(r) + W.EMPTY_MEMBER if packed else r for r in recs]


def test_salvage_recovers_every_intact_record():
    rng = random.Random(5)
    for packed in (True, False):
        for trial in range(60):
            parts = archive(12, packed)
            hurt = set(rng.sample(range(12), rng.randint(0, 4)))
            for i in hurt:
                at = rng.randrange(len(parts[i]) - (24 if packed else 0))
                kind = rng.choice(("flip", "cut", "junk", "gone"))
                p = parts[i]
                parts[i] = {"flip": p[:at] + bytes([p[at] ^ 0x55]) + p[at + 1:], "cut": p[:at],
                            "junk": p[:at] + bytes(rng.randrange(256) for _ in range(40)) + p[at:], "gone": b""}[kind]
            data = b"".join(parts)
            out = list(W.salvage(data))
            ids = {W._page_id(x["fields"][b"warc-record-id"]) for k, _, _, x in out if k == "record"}
            # a cut record may swallow the start of its successor only when it is not packed
            must = {i for i in range(12) if i not in hurt and (packed or i - 1 not in hurt)}
            assert must <= ids
            at = 0
            for kind, start, stop, _ in out:
                assert not data[at:start].replace(W.EMPTY_MEMBER, b"")
                at = stop
            assert not data[at:].replace(W.EMPTY_MEMBER, b"")


def test_gap_is_logged_with_its_bytes():
    parts = archive(3, True)
    data = parts[0] + b"garbage" + parts[1][:30] + parts[2]
    gaps = [(a, b, r) for k, a, b, r in W.salvage(data) if k == "gap"]
    assert [(a, b) for a, b, _ in gaps] == [(len(parts[0]), len(parts[0]) + 37)] and gaps[0][2]


def test_plain_record_whose_block_names_a_version_line():
    rec = W.record_bytes(1, "u", b"WARC/1.0\r\nWARC-Type: x\r\n\r\n", 27, "", "response", None)
    assert [k for k, *_ in W.salvage(rec + rec)] == ["record", "record"]


def ids_of(out):
    return [W._page_id(x["fields"][b"warc-record-id"]) for k, _, _, x in out if k == "record"]


def test_block_digests_of_other_writers():
    rec = W.record_bytes(1, "u", b"<p>1</p>", 8, "", "response", None)
    line = re.search(rb"WARC-Block-Digest: [^\r]*\r\n", rec)[0]
    sha1 = hashlib.sha1(b"<p>1</p>")
    good = [b"sha1:" + base64.b32encode(sha1.digest()), b"sha1:" + sha1.hexdigest().encode(),
            b"md5:" + hashlib.md5(b"<p>1</p>").hexdigest().encode(), b"sha-256:" + hashlib.sha256(b"<p>1</p>").hexdigest().upper().encode()]
    for value, note in [(g, None) for g in good] + [(b"blake9:00", "block digest not checked: blake9")]:
        (kind, _, _, got), = W.salvage(W.member(rec.replace(line, b"WARC-Block-Digest: " + value + b"\r\n")))
        assert kind == "record" and got["note"] == note
    assert ids_of(W.salvage(rec.replace(line, b""))) == [1]
    assert [k for k, *_ in W.salvage(rec.replace(line, b"WARC-Block-Digest: sha1:" + b"A" * 32 + b"\r\n"))] == ["gap"]


def test_member_of_several_records():
    parts = archive(6, False)
    bad = parts[2].replace(b"<p>2", b"<q>2", 1)
    out = list(W.salvage(W.member(b"".join(parts[:2] + [bad] + parts[3:]))))
    assert ids_of(out) == [0, 1, 3, 4, 5]
    a = len(parts[0] + parts[1])
    assert [x for k, _, _, x in out if k == "gap"] == [f"block digest differs (unpacked bytes {a} to {a + len(bad)})"]
    noise = [re.sub(rb"</p>$", b"", r) for r in archive(6, False)]
    whole = W.member(b"".join(noise), 0)  # stored, so the cut is a place in the records
    cut = whole[:len(b"".join(noise[:4])) + 60]
    assert ids_of(W.salvage(cut)) == [0, 1, 2, 3]
    hurt = whole[:-8] + bytes([whole[-8] ^ 1]) + whole[-7:]
    assert ids_of(W.salvage(hurt)) == list(range(6))


def test_query_matches_duckdb(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF_SMALL}/pages.parquet'")
    got = sorted(tuple(r) for r in W.op4_warc_salvage(spark, SF_SMALL).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    assert got == sorted(con.execute(W.ORACLE).fetchall())
