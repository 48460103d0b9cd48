"""Counts against a plain version; verdicts on made groups."""

import random
from itertools import combinations

import numpy as np
import pytest

from tidemark.llm import quality_rules as rules
from tidemark.session import cut


def plain_counts(text):
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\v\f\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    lines, dup = [], 0
    for line in text.split("\n"):
        if line.strip(" \t\v\f\r"):
            dup += line in lines
            lines.append(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_counts():
    rnd = random.Random(3)
    texts = ["", None, " \n ", "a b c a b c", "a a a a", "é x y z", "x\n\nx\n x\nx", "#*$%&|<> ##"]
    texts += ["".join(rnd.choice("ab \n\té#") for _ in range(rnd.randrange(120))) for _ in range(400)]
    assert [t for t in texts if rules.count_text(t)[:5] != plain_counts(t)] == []


def test_chi2():
    assert abs(rules.chi2_quantile(0.95, 7) - 14.0671) < 1e-3 and abs(rules.chi2_cdf(2.0, 2) - 0.6321206) < 1e-6


def make(rnd, n=120):
    return " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 9))) for _ in range(n + rnd.randrange(200)))


def test_outliers_go_and_clean_rows_stay(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["en", None]), rnd.choice(["s0", "s0", "s1", None]), make(rnd)) for i in range(1500)]
    rows += [(10_000 + i, "en", "s0", make(rnd).replace(" ", "### ")) for i in range(60)]
    rows += [(20_000, "en", "s0", ""), (20_001, None, None, None), (20_002, "en", "s0", "word " * 300), (20_003, "xx", "rare", make(rnd)), (20_003, "xx", "rare", make(rnd))]
    docs = spark.createDataFrame([(*r, 5, True) for r in rows], "doc_id long, lang string, source string, text string, n_words int, kept boolean")
    got = rules.accepted(docs)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert not {i for i in ids if 10_000 <= i < 20_003}
    assert sum(i < 1500 for i in ids) >= 1495 and ids.count(20_003) == 2
    assert rules.accepted(docs.limit(0)).count() == 0
    assert rules.accepted(docs.where("doc_id < 20")).count() == docs.where("doc_id < 20").count()  # few rows lean on the wide estimate


def test_base_rule_and_columns(spark):
    docs = spark.createDataFrame([(1, "en", "a", "x " * 49), (2, "en", "a", " ".join(map(str, range(60)))), (3, None, None, None)], "doc_id long, lang string, source string, text string")
    rows = cut(rules.with_counts(docs))
    got = {r.doc_id: r for r in rules.judged(rows, rules.fit(rows)).collect()}
    assert [got[i].base_failed for i in (1, 2, 3)] == [True, False, True] and [got[i].kept for i in (1, 2, 3)] == [False, True, False]


def test_drawn_estimates():
    """Small groups lean on larger ones, large ones on themselves."""
    p, eye = rules.P, np.eye(rules.P)
    levels = lambda n: [(1e9, np.zeros(p), eye), (1e9, np.ones(p), 4 * eye), (n, np.full(p, 3.0), 9 * eye)]
    for n, mean, var in ((0, 1, 4), (rules.WEIGHT, 2, 6.5), (1e12, 3, 9)):
        got, inverse = rules.drawn(levels(n), rules.WEIGHT)
        assert np.allclose(got, mean, atol=1e-4) and np.allclose(inverse.reshape(p, p), eye / var, atol=1e-4)
    alone = rules.drawn([(0, np.zeros(p), 0 * eye)], rules.WEIGHT)[1].reshape(p, p)
    assert np.allclose(np.diag(alone), [1 / x**2 for x in rules.WIDE.values()])


def test_estimate_against_every_subset(spark):
    """The determinant of a small group's estimate is near the least of all subsets of that size."""
    rnd = np.random.default_rng(8)
    x = rnd.normal(0, 1, (11, rules.P))
    x[:2] += 25
    share = int(np.ceil(rules.H * len(x)))
    least = min((rules._fit(share, s.sum(0), (s.T @ s)[np.triu_indices(rules.P)], rules.CONSISTENT)[3] for s in (x[list(c)] for c in combinations(range(len(x)), share))))
    rows = cut(spark.createDataFrame([("g", "s", False, r.tolist()) for r in x], "lang string, source string, base_failed boolean, _x array<double>"))
    e = rules.fit(rows, weight=0.0).first()["_e"]
    inverse = np.array(e["inverse"]).reshape(rules.P, rules.P)
    assert -np.linalg.slogdet(inverse)[1] <= least + 1.0
    far = [(r - e["mean"]) @ inverse @ (r - e["mean"]) for r in x]
    assert sorted(np.argsort(far)[-2:].tolist()) == [0, 1]


@pytest.mark.parametrize("table", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_labelled_rows(spark, table):
    from tidemark.llm.q_quality import op6_quality_rules

    got = op6_quality_rules(spark, table).join(spark.read.parquet(f"{table}/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert sum(r.kept for r in got if r.quality == 1) >= 0.99 * sum(r.quality for r in got)
    assert sum(r.kept for r in got if r.quality == 0) <= 0.1 * sum(1 - r.quality for r in got)


def test_clashing_columns_and_long_texts(spark):
    rnd = random.Random(9)
    long = " ".join(make(rnd) for _ in range(900))
    rows = [(i, "en", "s0", make(rnd)) for i in range(40)] + [(90, "en", "s0", long), (91, "en", "s0", "x" * 1_000_000), (92, "en", "s0", "word " * 200_000)]
    more = {"_lang": "a", "_source": "b", "kept": "c", "base_failed": "d", "distance2": "e", "_x": "f", "_c": "g", "_e": "h", "in_lang": "i", "_key": "j"}
    frame = spark.createDataFrame([(*r, *more.values()) for r in rows], "doc_id long, lang string, source string, text string, " + ", ".join(f"{c} string" for c in more))
    ids = {r.doc_id for r in rules.accepted(frame).collect()}
    assert rules.accepted(frame).columns == frame.columns and set(range(40)) <= ids and not ids & {91, 92}
    rows = cut(rules.with_counts(frame))
    got = rules.judged(rows, rules.fit(rows))
    assert {r.doc_id for r in got.where("kept").collect()} == ids and {r["_lang"] for r in got.collect()} == {"a"} and {r.in_lang for r in got.collect()} == {"i"}
    assert dict(got.dtypes)["kept"] == "boolean" and dict(got.dtypes)["distance2"] == "double"
