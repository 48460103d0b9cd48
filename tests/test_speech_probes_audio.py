"""Scripts of reports, probes of pages in several charsets, and the audio store through deaths of its writers."""

import hashlib
import json
import random
import time
import unicodedata
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import speech
from tidemark.sources import probes
from tidemark.sources.audio_store import AudioStore, source_sha

# scripts


def plain_line(text):
    import re

    text = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", text)
    for mark in ("`", "**", "__", "~~", "*"):
        text = text.replace(mark, "")
    text = "".join(c for c in text if unicodedata.category(c) not in ("So", "Cs", "Co") and ord(c) not in (0xFE0E, 0xFE0F, 0x200D, 0x20E3))
    return " ".join(text.replace("·", ", ").replace("ㆍ", ", ").split())


def plain_script(md, day):
    import re

    parts, titles = [[]], []
    for line in (md or "").splitlines():
        m = re.match(r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line)
        if m and len(m[1]) == 2:
            titles.append(plain_line(m[2]))
            parts.append([])
            continue
        said = plain_line(re.sub(r"^\s*(?:[-*+]|\d+[.)])\s+", "", re.sub(r"^\s*>\s?", "", m[2] if m else line)))
        if any(c.isalnum() for c in said):
            parts[-1].append(said if said[-1] in ".?!…" else said + ".")
    n = len(titles)
    count = speech.COUNTS[n - 1] if 0 < n <= 10 else str(n)
    blocks = [" ".join([f"{day.month}월 {day.day}일 커뮤니티 데일리 리포트입니다. 모두 {count} 가지 이야기를 전해 드립니다.", *parts[0]])]
    for i, (title, body) in enumerate(zip(titles, parts[1:])):
        full = title if not title or title[-1] in ".?!…" else title + "."
        blocks.append(f"{speech.ORDINALS[i] if i < 10 else i + 1} 번째 이야기. {full} {' '.join(body)}".strip())
    return "\n<long pause>\n".join(blocks), blocks, titles


def test_scripts(spark):
    draw = random.Random(1)
    pieces = ["## **첫 소식** 😀", "# big", "### small ##", "- item [link](http://x.y/z)", "> quoted `code`", "1. one", "---", "", "plain·dot ㆍ and ~~gone~~", "끝났다!", "##no space", "  ## indented ## ", "    ## code", "* star *emph*", "😀 ✨", "## ", "ends…", "tab\tand  spaces", "## q?"]
    texts = ["\n".join(draw.choices(pieces, k=draw.randrange(1, 14))) for _ in range(120)] + ["\r\n".join(pieces), "", None, "\n".join(f"## s{i}\nbody {i}" for i in range(12))]
    day = date(2026, 3, 9)
    frame = spark.createDataFrame([(i, t, day) for i, t in enumerate(texts)] + [(999, "## x", None)], "i int, md string, d date")
    got = {r.i: r.s for r in frame.select("i", speech.script(F.col("md"), F.col("d")).alias("s")).collect()}
    assert got.pop(999) is None
    for i, t in enumerate(texts):
        want = plain_script(t, day)
        assert (got[i].text, list(got[i].blocks), list(got[i].titles)) == (want[0], want[1], want[2]), t


def test_scripts_of_many_lines(spark):
    # a fold that copies what it has at each line takes minutes for this
    text = "intro\n" + "\n".join("## head" if i % 40_000 == 7 else f"line {i}" for i in range(120_000))
    began = time.monotonic()
    made = spark.createDataFrame([(text, date(2026, 3, 9))], "md string, d date").select(speech.script(F.col("md"), F.col("d")).alias("s")).first().s
    assert time.monotonic() - began < 60
    want = plain_script(text, date(2026, 3, 9))
    assert (made.text, list(made.blocks), list(made.titles)) == (want[0], want[1], want[2])


# probes


def plain_decode(body, charset):
    head = body[: probes.SCAN_BYTES]
    for name in (None if (charset or "").lower() in ("", "iso-8859-1", "latin-1") else charset, "utf-8", "cp949"):
        try:
            if name:
                return head.decode(name)
        except (UnicodeDecodeError, LookupError):
            pass
    return head.decode("utf-8", errors="replace")


def test_charsets(spark):
    han = "한국어 본문 '보안 검사' "
    rows = [(han.encode(), None), (han.encode("cp949"), None), (han.encode("cp949"), "EUC-KR"), (han.encode("cp949"), "utf-8"), (b"caf\xe9 \xff\xfe x", None), (b"caf\xe9", "windows-1252"), (b"caf\xe9", "ISO-8859-1"), (b"plain", "no-such"), (b"", None), (han.encode(), "latin-1"), ("é".encode("utf-8"), "cp949"), (han.encode("utf-16"), "utf-16"), ((han * 20_000).encode("cp949"), None), (b"ok \xc3", "UTF-8"), (han.encode(), " UTF8 ")]
    frame = spark.createDataFrame([(i, bytearray(b), c) for i, (b, c) in enumerate(rows)] + [(99, None, "utf-8")], "i int, body binary, charset string")
    got = {r.i: r.t for r in frame.select("i", probes.decoded(F.col("body"), F.col("charset")).alias("t")).collect()}
    assert got.pop(99) is None
    for i, (body, charset) in enumerate(rows):
        assert got[i] == plain_decode(body, charset.strip() if charset else charset), (i, body[:40], charset)
    alone = {r.i: r.t for r in frame.where("i < 2").select("i", probes.decoded(F.col("body")).alias("t")).collect()}
    assert alone == {0: han, 1: han}


def test_counts(spark):
    feeds = {b"<rss><item>a</item><item >b</item><items/></rss>": 2, b"<feed><entry\n>x</entry></feed>": 1, "<item>한</item>".encode("cp949"): 1, b"": 0, None: 0}
    frame = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate(feeds)], "i int, body binary")
    assert [r.n for r in frame.select("i", probes.feed_items(F.col("body")).alias("n")).orderBy("i").collect()] == list(feeds.values())
    answers = {"[1, 2, 3]": 3, '{"items": [1], "data": [1, 2]}': 1, '{"items": {"a": 1}, "list": [1, 2]}': 2, '{"result": []}': 0, '{"x": [1]}': 0, "5": 0, '"text"': 0, "not json": None, "": None, '{"posts": [': None, None: None}
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(answers)], "i int, t string")
    assert [r.n for r in frame.select("i", probes.json_items(F.col("t")).alias("n")).orderBy("i").collect()] == list(answers.values())


def test_verdicts(spark):
    links = "".join(f'<a href="/p/1000{i}">x</a>' for i in range(6)).encode()
    cases = [
        (200, links, None, 3, "ok"), (200, links, None, None, "ok"), (200, b"<p>hi", None, None, "ok"), (200, b"", None, 0, "empty"), (430, links, None, 3, "blocked"), (404, b"", None, None, "http-404"), (500, b"", None, None, "http-500"), (None, None, None, None, "error"),
        (200, b"<title>Just a  moment</title>", None, None, "blocked"), (200, "보안 검사중".encode("cp949"), None, 0, "blocked"), (200, b"captcha" + links, None, None, "ok"), (200, b"captcha" + links, None, 0, "blocked"), (200, b"captcha", None, 4, "ok"),
        (200, b"<script>location.href = '/msg.html'</script>", None, None, "blocked"), (200, b"hello", "https://x/msg.html", 0, "blocked"), (200, links, "CHALLENGE", 5, "blocked"),
    ]
    rows = [(i, s, None if b is None else bytearray(b), u if u and "/" in u else None, u if u and "/" not in u else None, n) for i, (s, b, u, n, _) in enumerate(cases)]
    frame = spark.createDataFrame(rows, "i int, status int, body binary, final_url string, mitigated string, rows long")
    got = probes.probed(frame).orderBy("i").collect()
    assert [r.verdict for r in got] == [c[-1] for c in cases] and got[0].article_links == 6 and got[8].title == "Just a moment"
    grouped = probes.by_group(probes.probed(frame).withColumn("group", F.lit("g")))
    assert {r.verdict: r.n for r in grouped.collect()} == {v: [c[-1] for c in cases].count(v) for v in {c[-1] for c in cases}}
    wanted = spark.createDataFrame([("u1", 1, "a"), ("u2", 3, "b"), ("u2", 2, "c"), ("u3", 4, "d")], "url string, seq int, id string")
    assert sorted(r.id for r in probes.still_to_probe(wanted, spark.createDataFrame([("u3",), ("u3",)], "url string")).collect()) == ["a", "c"]


# audio

CLIP = "date string, sha string, audio binary, duration double, sections array<struct<title:string,start:double>>, model string, voice string, boundary string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def clip(spark, day, text, audio=b"sound", duration=12.345, sections=(("a", 0.0), ("b", 3.456))):
    return spark.createDataFrame([(day, sha(text), None if audio is None else bytearray(audio), duration, list(sections), "m", None, "x")], CLIP)


def test_audio_store(spark, tmp_path):
    store = AudioStore(spark, str(tmp_path / "audio"))
    reports = spark.createDataFrame([("2026-03-01", "one"), ("2026-03-02", "two"), ("2026-03-03", "three")], "date string, summary_md string")
    waiting = lambda: sorted(r.date for r in store.wanting(reports).collect())
    assert store.clips().count() == 0 and waiting() == ["2026-03-01", "2026-03-02", "2026-03-03"] and store.prune(date(2026, 3, 9)) == []
    assert reports.select(source_sha(F.col("summary_md")).alias("s")).first().s == sha("one")
    store.save(clip(spark, "2026-03-01", "one").unionByName(clip(spark, "2026-03-02", "two", b"other")))
    assert waiting() == ["2026-03-03"]
    shown = {r.date: r for r in store.public(reports, "https://s").collect()}
    assert shown["2026-03-01"].url == f"https://s/audio/2026-03-01.mp3?v={sha('one')[:8]}" and shown["2026-03-01"].duration in (12.34, 12.35)
    assert [tuple(s) for s in shown["2026-03-01"].sections] == [("a", 0.0), ("b", 3.46)] and shown["2026-03-01"].voice == ""
    store.save(clip(spark, "2026-03-01", "one, rewritten"))  # another text of the same day
    assert waiting() == ["2026-03-01", "2026-03-03"] and {r.sha for r in store.clips().collect()} == {sha("one, rewritten"), sha("two")}
    store.save(clip(spark, "2026-03-03", "three", audio=None))  # no data: nothing is written
    store.save(clip(spark, "2026-03-03", "three", sections=(("a", -1.0),), duration=float("inf")))
    last = {r.date: r for r in store.public(reports, "").collect()}["2026-03-03"]
    assert last.sections == [] and last.duration == 0.0
    assert store.prune(date(2026, 3, 15)) == ["2026-03-01"] and {r.date for r in store.clips().collect()} == {"2026-03-02", "2026-03-03"}


def test_deaths_between_data_and_description(spark, tmp_path, monkeypatch):
    store = AudioStore(spark, str(tmp_path / "audio"))
    reports = spark.createDataFrame([("2026-03-01", "one")], "date string, summary_md string")
    whole = store._written

    def dies(clips, kind):
        if kind == "meta":
            raise RuntimeError("died")
        whole(clips, kind)

    monkeypatch.setattr(store, "_written", dies)
    with pytest.raises(RuntimeError):
        store.save(clip(spark, "2026-03-01", "one"))
    monkeypatch.undo()
    assert store.clips().count() == 0 and store.wanting(reports).count() == 1
    store.save(clip(spark, "2026-03-01", "one"))
    assert store.wanting(reports).count() == 0
    monkeypatch.setattr(store, "_written", dies)  # a rewrite that dies leaves the report without audio, not with a mixed pair
    with pytest.raises(RuntimeError):
        store.save(clip(spark, "2026-03-01", "one", b"new sound"))
    monkeypatch.undo()
    assert store.wanting(reports).count() == 1
    store.save(clip(spark, "2026-03-01", "one", b"new sound"))
    assert bytes(store.clips().first().audio) == b"new sound"
    # data that isn't what was described
    folder = tmp_path / "audio" / "data" / "date=2026-03-01" / f"sha={sha('one')}"
    spark.createDataFrame([(bytearray(b"other!"),)], "audio binary").write.mode("overwrite").parquet(str(folder))
    assert store.clips().count() == 0 and store.wanting(reports).count() == 1
    assert json.dumps(store.prune(date(2026, 4, 1))) == '["2026-03-01"]'
