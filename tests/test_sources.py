from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from palimpsest.sources.mail import split_mailbox
from palimpsest.sources import SINKS, SOURCES, read_source, register_sink, register_source, run_import
from palimpsest.sources.chat_export import estimate_chat_export
from palimpsest.sources.mail import estimate_mbox, read_mbox
from palimpsest.sources.stores import archive_text


def rows(df):
    return {r["text"]: r for r in df.collect()}


def at(*args):
    return dt.datetime(*args)


def test_chat_exports(spark, tmp_path):
    (tmp_path / "WhatsApp Chat with Ali.txt").write_text(
        "[1/2/24, 3:45:12 PM] Ali: hey\nsecond line\n[1/2/24, 3:46:00 PM] Sam: hi\n"
        "[1/13/24, 12:05:00 AM] Ali: ‎image omitted\n[1/13/24, 12:06:00 AM] Ali: ‎Ali changed the subject\nlost line\n",
        encoding="utf-8",
    )
    (tmp_path / "Group.txt").write_text(
        "02.01.2024 15:45 - Sam: merhaba\n03.01.2024 00:10 - Bo: selam\n03.01.2024 00:11 - +90 532 111 22 33: ne haber\n"
        "31.12.2024 10:00 - Bo created group \"x\"\n",
        encoding="utf-8",
    )
    (tmp_path / "Strangers.txt").write_text("1/2/24, 3:45 PM - A: x\n1/2/24, 3:46 PM - B: y\n", encoding="utf-8")
    ref, df = read_source(spark, "chat_export", str(tmp_path), names=["Sam"])
    got = rows(df)
    assert ref.kind == "whatsapp"
    assert set(got) == {"hey\nsecond line", "hi", "<Media omitted>", "merhaba", "selam", "ne haber"}
    assert got["hey\nsecond line"]["ts"] == at(2024, 1, 2, 15, 45, 12) and got["hi"]["is_me"]
    assert got["<Media omitted>"]["ts"] == at(2024, 1, 13, 0, 5)
    assert got["hi"]["conversation_title"] == "Ali" and not got["hi"]["is_group"]
    assert got["merhaba"]["ts"] == at(2024, 1, 2, 15, 45) and got["merhaba"]["is_group"]
    assert got["ne haber"]["sender_handle"] == "+90 532 111 22 33" and got["selam"]["sender_name"] == "Bo"
    assert got["selam"]["conversation_title"] == "Bo, +90 532 111 22 33"
    n = {r["path"].rsplit("/", 1)[-1]: r["estimate"] for r in estimate_chat_export(spark, str(tmp_path)).collect()}
    assert n["Group.txt"] == 4
    with pytest.raises(ValueError):
        read_source(spark, "chat_export", str(tmp_path))


MAILBOX = """From sam@x.org Tue Jan  2 10:00:00 2024
From: Sam <Sam@X.org>
Subject: Plan
Message-ID: <1@x>
Date: Tue, 02 Jan 2024 10:00:00 +0000

Let us meet
>From here on

From bo@x.org Tue Jan  2 11:00:00 2024
From: =?utf-8?q?B=C3=B6?= <bo@x.org>
Subject: Re: Plan
Message-ID: <2@x>
Date: Tue, 02 Jan 2024 14:00:00 +0300
Content-Type: text/html; charset=utf-8

<p>Sure, <b>noon</b>?</p><blockquote>Let us meet</blockquote>

From news@x.org Tue Jan  2 12:00:00 2024
From: News <newsletter@x.org>
Subject: Plan
List-Id: <n>
Date: Tue, 02 Jan 2024 12:00:00 +0000

Buy now

From cy@x.org Tue Jan  2 13:00:00 2024
From: Cy <cy@x.org>
Subject: Other

Not my thread

From box@x.org Tue Jan  2 14:00:00 2024
From: Old <old@y.org>
Subject: Labelled
X-Gmail-Labels: Archived,Sent

Written elsewhere
"""


def test_mailbox(spark, tmp_path):
    (tmp_path / "all.mbox").write_text(MAILBOX, encoding="utf-8")
    got = rows(read_source(spark, "mbox", str(tmp_path), emails=["sam@x.org"])[1])
    assert set(got) == {"Let us meet\nFrom here on", "Sure, noon?", "Written elsewhere"}
    reply = got["Sure, noon?"]
    assert (reply["sender_name"], reply["sender_handle"]) == ("Bö", "bo@x.org")
    assert reply["ts"] == at(2024, 1, 2, 11) and reply["conversation_external_id"] == "subj:plan"
    assert got["Written elsewhere"]["is_me"] and got["Written elsewhere"]["ts"] == at(2024, 1, 2, 14)
    late = rows(read_mbox(spark, str(tmp_path), emails=["sam@x.org"], since="2024-01-02 12:00:00"))
    assert set(late) == {"Written elsewhere"}
    assert estimate_mbox(spark, str(tmp_path)).first()["estimate"] == 5
    with pytest.raises(ValueError, match="bo@x.org|sam@x.org"):
        (tmp_path / "none").mkdir()
        (tmp_path / "none" / "n.mbox").write_text(MAILBOX.split("X-Gmail")[0], encoding="utf-8")
        read_mbox(spark, str(tmp_path / "none"), emails=["nobody@x.org"])


def test_mail_files(spark, tmp_path):
    def put(box, name, sender, subject):
        body = f"From: {sender}\nSubject: {subject}\nDate: Tue, 02 Jan 2024 10:00:00 +0000\n\ntext of {name}\n".encode()
        folder = tmp_path / f"{box}.mbox" / "Messages"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.emlx").write_bytes(str(len(body)).encode() + b"\n" + body + b"<plist/>")

    put("Sent Messages", "1", "me@old.org", "Plan")
    put("INBOX", "2", "bo@x.org", "Re: Plan")
    put("INBOX", "3", "cy@x.org", "Other")
    put("Junk", "4", "bo@x.org", "Re: Plan")
    got = rows(read_source(spark, "emlx", str(tmp_path))[1])
    assert {k: v["is_me"] for k, v in got.items()} == {"text of 1": True, "text of 2": False}


def test_data_package(spark, tmp_path):
    base = tmp_path / "messages"
    for name in ("c1", "c2", "3"):
        (base / name).mkdir(parents=True)
    (base / "index.json").write_text(json.dumps({"1": "Direct Message with al", "2": None}))
    (base / "c2" / "channel.json").write_text(json.dumps({"type": 3, "recipients": ["al", "bo"]}))
    msg = [{"ID": "9", "Timestamp": "2024-01-02 15:45:12.123000+00:00", "Contents": " hi ", "Attachments": ""}]
    (base / "c1" / "messages.json").write_text(json.dumps(msg + [{"ID": "8", "Timestamp": "bad", "Contents": "x"}]))
    (base / "c1" / "messages.csv").write_text('ID,Timestamp,Contents,Attachments\n1,2024-01-01 00:00:00+00:00,hidden,\n')
    (base / "c2" / "messages.csv").write_text('ID,Timestamp,Contents,Attachments\n2,2024-01-01 00:00:00+00:00,"two\nlines ""q""",\n')
    (base / "3" / "messages.json").write_text(json.dumps([{**msg[0], "Contents": "third"}]))
    got = rows(read_source(spark, "data_package", str(tmp_path))[1])
    assert set(got) == {"hi", 'two\nlines "q"', "third"}
    assert (got["hi"]["conversation_title"], got["hi"]["is_group"]) == ("Direct Message with al", False)
    two = got['two\nlines "q"']
    assert (two["conversation_title"], two["is_group"]) == ("al, bo", True)
    assert (got["third"]["conversation_title"], got["third"]["is_group"]) == ("channel 3", True)


def test_documents_and_commits(spark, tmp_path):
    (tmp_path / "notes" / "sub").mkdir(parents=True)
    (tmp_path / "notes" / "node_modules").mkdir()
    (tmp_path / "notes" / "a.md").write_text("---\nx: 1\n---\nHello there")
    (tmp_path / "notes" / "sub" / "b.TXT").write_text("Below")
    (tmp_path / "notes" / "c.py").write_text("code")
    (tmp_path / "notes" / "node_modules" / "d.md").write_text("dep")
    got = rows(read_source(spark, "documents", str(tmp_path / "notes"))[1])
    assert {k: v["external_id"] for k, v in got.items()} == {"Hello there": "a.md#0", "Below": "sub/b.TXT#0"}
    assert got["Hello there"]["conversation_title"] == "notes" and got["Below"]["conversation_title"] == "sub"
    (tmp_path / "logs").mkdir()
    log = "a1\x1f2024-01-02T03:00:00+03:00\x1ffix it\n\nCc: x\x1e\nb2\x1f2024-01-02T04:00:00Z\x1fwip\x1e\n"
    (tmp_path / "logs" / "repo.log").write_text(log)
    got = rows(read_source(spark, "commit_log", str(tmp_path / "logs"))[1])
    assert list(got) == ["fix it"] and got["fix it"]["ts"] == at(2024, 1, 2) and got["fix it"]["conversation_title"] == "repo"


def test_archive_text():
    body = "selam".encode()
    mark = b"..NSString\x01\x94\x84\x01\x2b"
    assert archive_text(mark + bytes([len(body)]) + body) == "selam"
    assert archive_text(mark + b"\x81\x05\x00" + body) == "selam"
    assert archive_text(mark + b"\x82\x05\x00\x00\x00" + body + b"rest") == "selam"
    assert archive_text(b"nothing") is None and archive_text(None) is None


def test_batches_and_plugins(spark, tmp_path):
    batch = {"source": {"kind": "k", "label": "L"}, "messages": [{"conversation_external_id": "c", "text": "t", "ts": "2024-01-02T00:00:00Z", "is_me": True}]}
    (tmp_path / "b.json").write_text(json.dumps(batch))
    got = rows(read_source(spark, "batches", str(tmp_path))[1])
    assert got["t"]["register"] == "text" and got["t"]["ts"] == at(2024, 1, 2)

    @register_source("tests_source", label="mine")
    def read(session, path):
        return session.createDataFrame([("c", "x")], "conversation_external_id string, text string")

    @register_sink("tests_sink")
    def write(ref, messages):
        return messages.agg(F.lit(ref.kind).alias("kind"), F.count("*").alias("n"))

    assert tuple(run_import(spark, "tests_source", "/p", "tests_sink").first()) == ("tests_source", 1)
    SOURCES.pop("tests_source"), SINKS.pop("tests_sink")


def test_mailbox_keeps_bytes_of_any_charset(spark, tmp_path):
    head = b"From me@x.org Mon Jan  1 10:00:00 2024\nFrom: Me <me@x.org>\nTo: you@x.org\nSubject: s\nMessage-ID: <%d@x>\nDate: Mon, 1 Jan 2024 10:00:0%d +0000\n"
    latin = head % (1, 1) + b"Content-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: 8bit\n\nGr\xfc\xdfe\xa0an alle hier\n\n"
    plain = head % (2, 2) + b"Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n" + "Grüße noch einmal".encode() + b"\n"
    (tmp_path / "a.mbox").write_bytes(latin + plain)
    rows = split_mailbox(spark, str(tmp_path)).orderBy("seq").collect()
    assert [bytes(r["data"]).count(b"\xfc\xdf") for r in rows] == [1, 0]
    assert "Grüße".encode() in bytes(rows[1]["data"]) and rows[0]["envelope"] == "Mon Jan  1 10:00:00 2024"


def test_headers_are_read_without_bodies(spark):
    from palimpsest.sources import mail

    heads = [b"From: a@x.de\r\nSubject: one\r\n\r\nSubject: no", b"From: a@x.de\nSubject: two\n\nSubject: no", b"Subject: three"]
    raw = spark.createDataFrame(
        [("p", k, bytearray(h), None, False) for k, h in enumerate(heads)],
        "path string, seq long, data binary, envelope string, in_sent boolean",
    )
    parsed = mail.parse_headers(raw)
    assert [r["subject"] for r in parsed.orderBy("seq").collect()] == ["one", "two", "three"]
    assert "MapInPandas" not in parsed._jdf.queryExecution().toString()
