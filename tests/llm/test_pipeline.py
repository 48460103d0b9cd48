"""The pipeline's stages on small tables, and run() against a plain version of all five."""

import base64
import hashlib
import itertools
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F
from test_quality_rules import plain_counts

import corpus_pipeline as pipeline
from tidemark.llm import mixing
from tidemark.llm import quality_rules as rules


def test_stages_keep_columns_and_follow_each_other(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before, counts = docs, []
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001").cache()
        counts.append(docs.count())
        assert docs.columns == pipeline.COLUMNS and docs.schema["doc_id"].dataType == before.schema["doc_id"].dataType, name
    assert before.count() >= counts[0] == counts[1] >= counts[2] > 0
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
    out = pipeline.STAGES[-1][1](spark, docs, "")
    assert out.count() == counts[-1]


def test_empty_and_null_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(None, None, None, None, None)], [(1, "x " * 10, "en", None, 20), (1, "x " * 10, "en", None, 20)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in pipeline.STAGES:
            assert stage(spark, docs, "").count() <= 2 * len(rows)


# all five stages once more, in plain Python and numpy


def at(values, share):
    """The value that a share of the values doesn't exceed."""
    return sorted(values)[max(math.ceil(share * len(values)), 1) - 1]


def plain_estimate(x):
    """Place and covariance of least determinant from both starts."""
    p, floor = x.shape[1], np.array(list(rules.FLOORS.values()))
    mid = np.array([at(c, 0.5) for c in x.T])
    wide = np.hypot([(at(c, 0.75) - at(c, 0.25)) / 1.349 for c in x.T], floor)
    y = (x - mid) / wide
    length = np.linalg.norm(y, axis=1, keepdims=True)
    signs = np.where(length > 0, y * wide / np.where(length > 0, length, 1) * math.sqrt(p), 0)
    found = []
    for cov in (np.diag(wide**2), np.cov(signs.T, bias=True) + np.diag(floor**2)):
        mean = mid
        for _ in range(rules.STEPS):
            distance = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            near = x[distance <= at(distance, rules.H) * (1 + 1e-12)]
            mean, cov = near.mean(axis=0), np.cov(near.T, bias=True) * rules.CONSISTENT + np.diag(floor**2)
        found.append((np.linalg.slogdet(cov)[1], len(found), mean, cov))
    return min(found)[2:]


def plain_rules(docs):
    counts = {d: plain_counts(d[1]) for d in docs}
    passed = [d for d in docs if counts[d][0] >= 50 and 100 * counts[d][4] <= 50 * counts[d][0]]
    upper, marks = set(map(chr, range(65, 91))), set(rules.MARKS.decode())

    def vector(d):
        n, chars, symbols, dup, again = counts[d]
        return [math.log(n), math.log(chars / n), math.log1p(20 * symbols / n), math.log1p(dup), again / n, math.sqrt(sum(c in upper for c in d[1]) / chars), math.sqrt(sum(c in marks for c in d[1]) / chars)]

    x = {d: np.array(vector(d)) for d in passed}
    group = lambda key: np.array([x[d] for d in passed if key(d)])
    limit, kept = rules.chi2_quantile(1 - rules.TAIL, rules.P), []
    known = {}
    for d in passed:
        if d[2:4] not in known:
            mean, cov = None, np.diag(np.square(list(rules.WIDE.values())))
            for rows in (group(lambda e: True), group(lambda e: e[2] == d[2]), group(lambda e: e[2:4] == d[2:4])):
                place, own = plain_estimate(rows)
                share = len(rows) / (len(rows) + rules.WEIGHT)
                mean = place if mean is None else share * place + (1 - share) * mean
                cov = share * own + (1 - share) * cov
            known[d[2:4]] = mean, np.linalg.inv(cov)
        mean, inverse = known[d[2:4]]
        if (x[d] - mean) @ inverse @ (x[d] - mean) <= limit:
            kept.append(d)
    return kept


def plain_lines(docs):
    pages, held = Counter(d[3] for d in docs), Counter()
    for d in docs:
        held.update({(d[3], x.strip(" ")) for x in d[1].split("\n") if x.strip(" ")})
    gone = {k for k, n in held.items() if n > 0.1 * pages[k[0]] and n >= 3}
    return [(d[0], "\n".join(x for x in d[1].split("\n") if (d[3], x.strip(" ")) not in gone), *d[2:]) for d in docs]


def plain_near(docs):
    sets = {}
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), d[1]))
        sets[d[0]] = {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()
    least = {i: i for i in sets}
    changed = True
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return [d for d in docs if least[d[0]] == d[0]]


def plain_mix(docs):
    size = {d[0]: len(re.findall(r"[^\x20\x09-\x0D]+", d[1])) for d in docs}
    names = sorted({d[3] for d in docs}, key=lambda s: (s is None, s or ""))
    own = {s: sum(size[d[0]] for d in docs if d[3] == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full, target = set(), {}
    while True:
        level = (1.5 * sum(own.values()) - sum(2 * own[s] for s in full)) / max(sum(weight[s] for s in names if s not in full), 1)
        target = {s: 2.0 * own[s] if s in full else level * weight[s] for s in names}
        more = {s for s in names if s not in full and target[s] > 2 * own[s]}
        if not more:
            break
        full |= more
    out = []
    for s in names:
        mine, rate = [d for d in docs if d[3] == s], target[s] / own[s] if own[s] else 0.0
        part = rate - math.floor(rate)
        drawn = {seed: {d[0] for d in mine if int(hashlib.md5(f"{seed}:{d[0]}".encode()).hexdigest()[:13], 16) / 2**52 < part} for seed in range(7, 7 + mixing.SEEDS)}
        seed = min(drawn, key=lambda k: (round(abs(sum(size[i] for i in drawn[k]) - part * own[s]), 6), k))
        out += [d for d in mine for _ in range(math.floor(rate) + (d[0] in drawn[seed]))]
    return out


def test_run_against_plain_version(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [tuple(r) for r in table.select("doc_id", F.coalesce("text", F.lit("")), "lang", "source").collect()]
    assert len({d[0] for d in docs}) == len(docs)
    want, sizes = docs, []
    for stage in (plain_rules, plain_lines, plain_near, plain_mix):
        want = stage(want)
        sizes.append(len(want))
    assert len(docs) > sizes[0] == sizes[1] > sizes[2] and sizes[3] > sizes[2]  # each stage that may drop or repeat rows does
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def row(d):
        ids = theirs.encode_ordinary(d[1])
        return d[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(d[1].encode()).hexdigest()

    got = pipeline.run(spark, "/root/testdata/sf0.001").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(map(row, want))


def test_verdicts_of_the_query_against_plain_version(spark):
    from tidemark.llm.q_quality import op6_quality_rules

    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")), "lang", "source").collect()]
    kept = {d[0] for d in plain_rules(docs)}
    got = {r.doc_id: r for r in op6_quality_rules(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == {d[0] for d in docs}
    for doc_id, text, *_ in docs:
        r, counts = got[doc_id], plain_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert (r.base_failed, r.kept) == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0], doc_id in kept)
