"""Operators made of DataFrame functions, on small tables and against plain Python."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import licenses, line_dedup, mixing, q_native, sharding

DOCS = "doc_id long, source string, text string, size string, _site int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)


# mixing


def fill(own, weights, budget=1.5, most=2.0):
    """Targets by sharing and resharing, as stated."""
    names = sorted(own, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, total, target = set(names), budget * sum(own.values()), {}
    while left:
        share = (total - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if share * weight[s] > most * own[s]}
        if not over:
            target |= {s: share * weight[s] for s in left}
            break
        target |= {s: most * own[s] for s in over}
        left -= over
    return target


@pytest.mark.parametrize("own", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 5, None: 7}, {"z": 0, "y": 3}, {"é": 50, "z": 1, "a": 900, "B": 3}, {"a": 0}])
def test_targets(spark, own):
    rows = spark.createDataFrame([(s, n) for s, n in own.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    want = fill(own, (3.0, 1.0, 2.0))
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-9) for s in want)


def test_copies_come_near_targets_and_agree(spark):
    rows = [(i, f"s{i % 7 and 1 + i % 3}", "w " * (1 + i * 7919 % 50)) for i in range(6000)]
    found = mixing.copies(docs(spark, rows)).collect()
    assert sorted(found) == sorted(mixing.copies(docs(spark, rows).repartition(5)).collect())
    for s in {r.source for r in found}:
        mine = [r for r in found if r.source == s]
        assert abs(sum(r.size * r.copies for r in mine) - mine[0].target) < 0.05 * mine[0].target
        assert max(r.copies for r in mine) <= 2
    emitted = mixing.mixed(docs(spark, rows))
    assert emitted.count() == sum(r.copies for r in found) and emitted.columns[:-1] == DOCS.replace(",", "").split()[::2]


def test_mixing_edges(spark):
    assert mixing.copies(docs(spark, [])).count() == 0
    got = mixing.copies(docs(spark, [(1, None, None), (None, "a", ""), (2, None, "a b")])).collect()
    assert {(r.doc_id, r.size) for r in got} == {(1, 0), (None, 0), (2, 2)} and all(r.copies <= 2 for r in got)


# line dedup


def test_drop_lines(spark):
    rows = [(i, "a" if i < 60 else "b" if i < 90 else None, f"own {i}\n  common \n\nnav\nown {i}" if i % 2 else f"nav\nx{i % 30}") for i in range(130)]
    rows += [(900, "tiny", "common\ncommon"), (901, "a", None), (902, "a", ""), (903, "a", "nav"), (903, "a", "nav")]
    sites = Counter(s for _, s, _ in rows)
    lines = Counter((s, x) for _, s, t in rows for x in {x.strip(" ") for x in (t or "").split("\n")} if x)
    drop = {(s, x) for (s, x), n in lines.items() if sites[s] >= 20 and n > 0.1 * sites[s]}
    want = sorted((i, s, t if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in drop)) for i, s, t in rows if i != 900)
    got = line_dedup.drop_lines(docs(spark, rows), counts=True)
    assert got.columns == [*DOCS.replace(",", "").split()[::2], "n_lines", "n_dropped"]
    key = lambda x: repr(x)
    assert sorted([(r.doc_id, r.source, r.text) for r in got.collect() if r.doc_id != 900], key=key) == sorted(want, key=key)
    assert got.where("doc_id = 900").first().text == "common\ncommon"
    assert line_dedup.drop_lines(docs(spark, [])).count() == 0


def test_drop_lines_of_small_sites(spark):
    rows = [(i, "a", f"nav\nown {i}") for i in range(19)] + [(30 + i, "b", f"foot\nown {i}" if i < 3 else f"twice\nown {i}") for i in range(5)]
    rows += [(50, "c", "same\npage"), (51, "c", "same\npage"), (60, None, "nav\nx"), (61, None, "nav\ny"), (62, None, "nav\nz")]
    want = {i: t if s == "c" else "\n".join(x for x in t.split("\n") if x not in ("nav", "foot")) for i, s, t in rows}
    got = line_dedup.drop_lines(docs(spark, rows)).collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(rows)
    assert line_dedup.drop_lines(docs(spark, rows), min_pages=20).where("text like '%nav%'").count() == 22
    assert line_dedup.drop_lines(docs(spark, rows), min_with=2).where("doc_id in (50, 51) and text = ''").count() == 2


def test_page_text_and_host(spark):
    got = spark.range(1).select(
        line_dedup.page_text(F.lit("<p>a<b>b</b></p><script>x<y</script><!-- <p>no -->\nend")).alias("t"),
        line_dedup.host(F.lit("HTTPS://u:p@WWW.Example.org:80/x?y")).alias("h"), line_dedup.host(F.lit("none")).alias("n"),
    ).first()
    assert [x for x in r.split("\n") if x] == ["a", "b", "end"] if (r := got.t) else False
    assert got.h == "www.example.org" and got.n is None


# licences


def test_license_variants(spark):
    mit = licenses.TEXTS["MIT"]
    rows = [
        (1, "MIT", mit), (2, "MIT", "Copyright (c) 2020 Somebody\nAll rights reserved.\n\n" + mit.upper().replace(" ", "\n ")),
        (3, "MIT", mit.replace("license", "licence").replace(",", " ;").replace("sublicense", "sub-licence")),
        (4, None, mit + "\nfurther terms"), (5, None, ""), (6, None, None), (7, None, "..."), (8, "MIT notice", "* Released under the MIT licence *"),
        (9, "BSD-3-Clause", "© 2001, 2002 X\n" + licenses.TEXTS["BSD-3-Clause"]), (9, "BSD-3-Clause", "© 2001, 2002 X\n" + licenses.TEXTS["BSD-3-Clause"]),
    ]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, want string, text string, license_id string")
    got = licenses.scan(frame).collect()
    assert len(got) == len(rows) and [r for r in got if r.license_id != r.want] == []
    assert {r.canonical_sha256 is None for r in got if r.text is None} == {True}
    assert licenses.scan(frame.limit(0)).count() == 0 and licenses.scan(frame, texts={}).where("license_id is not null").count() == 0


def test_license_forms(spark):
    common = lambda name: open(f"/usr/share/common-licenses/{name}").read()
    body, bsd = licenses.TEXTS["MIT-untitled"], licenses.TEXTS["BSD-3-Clause"]
    flowed = "\n\n".join(" ".join(p.split()) for p in common("Apache-2.0").split("\n\n"))
    plain = {
        "Apache-2.0": [common("Apache-2.0"), flowed, common("Apache-2.0").split("END OF TERMS")[0], "Distributed under the Apache-2.0 license"],
        "GPL-2.0": [common("GPL-2"), common("GPL-2").split("How to Apply")[0]], "GPL-3.0": [common("GPL-3"), "Licensed under GPLv3"],
        "LGPL-2.1": [common("LGPL-2.1")], "MPL-2.0": [common("MPL-2.0")], "CC0-1.0": [common("CC0-1.0")],
        "CC-BY-SA-4.0": [licenses.TEXTS["CC-BY-SA-4.0"], "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
        "MIT": ["The MIT License (MIT)\n\nCopyright The Foo Authors\n\n" + body, "MIT License\nCopyright: Foo Inc.\n" + body],
        "BSD-3-Clause": ["BSD 3-Clause License\n\nCopyright Foo\n" + bsd, "BSD 3-Clause License\n" + bsd.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")],
    }
    # a wrapped line of the text itself isn't a holder's
    plain["BSD-3-Clause"].append(bsd.replace("above copyright notice", "above\ncopyright notice").replace("the copyright holder nor", "the\ncopyright holder nor"))
    rows = [(k, text) for k, texts in plain.items() for text in texts]
    got = licenses.scan(spark.createDataFrame(rows, "want string, text string")).collect()
    assert [(r.want, r.license_id, r.text[:40]) for r in got if not (r.license_id or "").startswith(r.want)] == []


# sharding


def test_store(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else f"s{i % 3}", None if i % 11 == 0 else f"text {i} " * (i % 40)) for i in range(600)] * 2
    store = sharding.Store(spark, str(tmp_path / "s"), target_bytes=20_000, fanout=3, base_bytes=10_000)
    for k in range(3):
        store.append(docs(spark, rows).where(f"doc_id % 3 = {k}").withColumn("by", F.lit(k)), "by")
    first = store.manifest()
    assert [r.rows for r in first] == [400] * 3 and len(store.versions()) == 3
    store.append(docs(spark, rows).limit(0).withColumn("by", F.lit(9)), "by")
    assert store.manifest() == first
    assert store.compact() >= 1
    tiers = Counter(r.tier for r in store.manifest())
    assert max(tiers.values()) < 3 and sum(r.rows for r in store.manifest()) == 1200
    key = lambda r: (r.doc_id, r.source or "", r.text or "")
    assert sorted(map(key, store.read().collect())) == sorted(map(key, docs(spark, rows).collect()))
    assert store.read(3).count() == 1200  # older versions stay readable until vacuum
    assert store.vacuum() > 0 and store.read().count() == 1200
    with pytest.raises(FileExistsError):
        store.commit([], store.versions()[-1])
    assert store.compact() == 0
    assert [x.getPath().getName() for x in store._ls(f"{store.root}/tmp")] == []


def test_compact_without_old_runs(spark, tmp_path):
    store = sharding.Store(spark, str(tmp_path / "k"), fanout=2, base_bytes=1 << 20)
    store.append(docs(spark, [(i, "s", f"t{i}") for i in range(80)]).withColumn("by", F.col("doc_id") % 5), "by")
    assert store.compact(keep_old=False) >= 2 and store.read().count() == 80
    left = {str(x) for x in (tmp_path / "k" / "runs").rglob("*.parquet")}
    named = {str(x) for r in store.manifest() for x in (tmp_path / "k" / "runs" / r.folder).glob("*.parquet")}
    assert left == named != set()


def test_new_columns_and_clashing_names(spark, tmp_path):
    store = sharding.Store(spark, str(tmp_path / "m"), fanout=2)
    store.append(spark.range(10).withColumns({"by": F.lit(1), "run_id": F.lit("mine"), "Tier": F.lit(5)}), "by")
    store.append(spark.range(10, 20).withColumns({"by": F.lit(2), "more": F.lit("x")}), "by")
    assert store.compact() == 1
    rows = sorted((r.id, r.run_id, r.Tier, r.more) for r in store.rows().collect())
    assert rows == [(i, "mine", 5, None) for i in range(10)] + [(i, None, None, "x") for i in range(10, 20)]
    got = store.read()
    assert got.columns == ["id", "more", "run_id", "tier"] and {r.run_id for r in got.collect()} == {store.manifest()[0].run_id}
    with pytest.raises(ValueError):
        store.append(spark.range(3).withColumns({"by": F.lit(3), "more": F.lit(1)}), "by")
    assert store.rows().count() == 20


def test_deaths_of_writers(spark, tmp_path, monkeypatch):
    """A writer that dies before or after the rename of its version, or in a merge, leaves a store that reads and writes on."""
    store = sharding.Store(spark, str(tmp_path / "d"), fanout=2)
    frame = lambda a: spark.range(a, a + 10).withColumn("by", F.lit(1))
    ids = lambda: sorted(r.id for r in store.rows().collect())
    store.append(frame(0), "by")

    def dies(*_):
        raise KeyboardInterrupt

    for name in ("commit", "_moved", "_described"):
        with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
            m.setattr(sharding.Store, name, dies)
            store.append(frame(100), "by")
        assert ids() == list(range(10))
    moved = sharding.Store._moved
    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(sharding.Store, "_moved", lambda *a: moved(*a) and dies())
        store.append(frame(10), "by")
    assert ids() == list(range(20))  # the version was visible already
    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(sharding.Store, "commit", dies)
        store.compact()
    assert ids() == list(range(20))
    store.append(frame(20), "by")
    assert store.compact(keep_old=False) >= 1 and ids() == list(range(30)) and store.pending() == 0


def test_races_of_writers(spark, tmp_path, monkeypatch):
    """Another writer commits between the write and the commit of this one: an appender, a compaction, a vacuum."""
    store, other = (sharding.Store(spark, str(tmp_path / "r"), fanout=2) for _ in range(2))
    frame = lambda a: spark.range(a, a + 10).withColumn("by", F.lit(1))
    commit, done = sharding.Store.commit, []

    def meanwhile(what):
        def first(self, runs, version):
            if self is store and not done:
                done.append(1)
                what()
            return commit(self, runs, version)

        done.clear()
        monkeypatch.setattr(sharding.Store, "commit", first)

    meanwhile(lambda: other.append(frame(10), "by"))
    store.append(frame(0), "by")
    assert sorted(r.id for r in store.rows().collect()) == list(range(20))
    meanwhile(lambda: other.compact(keep_old=False))
    store.append(frame(20), "by")
    assert sorted(r.id for r in store.rows().collect()) == list(range(30))
    store.append(frame(30), "by")
    meanwhile(lambda: other.compact())  # both merge the same runs
    store.compact()
    assert sorted(r.id for r in store.rows().collect()) == list(range(40)) and store.pending() == 0
    meanwhile(lambda: other.vacuum())
    store.append(frame(40), "by")
    assert sorted(r.id for r in store.rows().collect()) == list(range(50))


def test_sharding_query(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, q_native.op9_sharding(spark, sf).collect()))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got == sorted(duckdb.sql(q_native.OP9_SQL).fetchall())


def test_empty_store(spark, tmp_path):
    store = sharding.Store(spark, str(tmp_path / "e"))
    assert store.manifest() == [] and store.versions() == []
    with pytest.raises(ValueError):
        store.read()
    empty = spark.createDataFrame([], "id long, by int, text string, tier int")
    assert store.append(empty, "by") == [] and store.versions() == [1]
    assert store.rows().columns == ["id", "text", "tier"] and store.rows().count() == 0
    assert store.read().columns == ["id", "text", "run_id", "tier"] and store.read().count() == 0 and store.pending() == store.compact() == 0
    for i in range(5):  # schemas of empty tables are no runs to merge
        store.append(empty, "by")
    assert store.pending() == 0
    store.append(spark.createDataFrame([(7, 1, "x", 3)], "id long, by int, text string, tier int"), "by")
    assert [(r.id, r.text) for r in store.read().collect()] == [(7, "x")] and store.pending() == 0


def test_sharding_query_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert q_native.op9_sharding(spark, str(tmp_path)).count() == 0


def long_texts():
    """Texts of a megabyte each: words, one word, one line, short lines."""
    return [" ".join(f"w{i % 977}" for i in range(200_000)), "x" * 1_000_000, "a b " * 250_000, "line\n" * 200_000]


def test_very_long_texts(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(long_texts())]
    frame = docs(spark, [(i, "s", t) for i, t in rows])
    sizes = {r.doc_id: r.size for r in mixing.copies(frame).collect()}
    assert sizes == {i: len(t.split()) for i, t in rows}
    found = {r.doc_id: r.license_id for r in licenses.scan(frame).collect()}
    assert found == dict.fromkeys(sizes)
    cut_lines = {r.doc_id: (r.n_lines, r.text == t) for r, (_, t) in zip(sorted(line_dedup.drop_lines(frame, "source", "text", counts=True).collect(), key=lambda r: r.doc_id), rows)}
    assert cut_lines == {0: (1, True), 1: (1, True), 2: (1, True), 3: (200_000, True)}
    store = sharding.Store(spark, f"{tmp_path}/long")
    store.append(frame, "_site")
    assert {r.doc_id: r.text for r in store.read().collect()} == dict(rows)
