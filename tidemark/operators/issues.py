"""Issues: posts of several sources about one thing, by words and near-equal titles.

Posts have id (arrival; breaks ties), source, title, url_key, rank, rank_score, comments, event_ts (or null), and what
titles.features() gives, which is added where toks isn't there. Every step is a join or an aggregation on words; the only
loops are components' rounds. Names are made of an issue's counts, representatives are chosen greedily within its posts.
"""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.fixed_words import WHY_EVENTS
from tidemark.functions.titles import Rules, features, split_title
from tidemark.operators import naming
from tidemark.operators.graph import components as every_component
from tidemark.operators.history import status, status_reason
from tidemark.operators.ranking import community_context
from tidemark.operators.similarity import DUPLICATE, NUMBER_HOME, cooccurrence, jaccard_pairs, token_idf
from tidemark.operators.stats import heat, second_earliest, spread_heat
from tidemark.session import cut

# Fixed values of the sites: titles that offer goods; titles that don't go on top, that count for less, and that jest; what no name
# has.
DEAL = r"네이버페이|네페|적립|[0-9]+원\s*\+|할인|세일|특가|쿠폰|\(무료\)|/무료\)|핫딜|\$[0-9]+"
UNSAFE = r"ㅈ됐|ㅈ된|ㅈ같|약혐|혐\)|ㅇㅎ|ㅎㅂ|후방|19금|오르가즘|야짤|노출|섹스|야스|씹|존나|좆|씨발|시발|ㅅㅂ|새끼|병신|ㅂㅅ|지랄|북돼지|니미"
LEWD = r"약혐|혐\)|ㅇㅎ|후방|19금|오르가즘|야짤|노출|ㅗ"
MEME = r"ㅋㅋ|ㄷㄷ|ㅎㅎ|존나|시발|씨발|ㅅㅂ|새끼"
PROFANITY = r"존나|좆|씨발|시발|ㅅㅂ|새끼|병신|ㅂㅅ|개새|지랄|닥쳐|북돼지"
NUMBER = r"^[0-9]"
#: Fixed values of the clustering rules.
MERGE_CO, MERGE_SHARE, BIG_POSTS, BIG_SOURCES, COHESION, SURE_POSTS = 2, 0.3, 15, 8, 0.5, 4
ITEMS, HOT, REPS, KEYWORDS, EXPLAINED, FULL_TITLE = 8, 6, 3, 4, 4, 36
#: Edges that one task joins; a round of posts has fewer, and more are joined in rounds over all tasks.
ONE_TASK_EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    return every_component(edges, one_task_rows=ONE_TASK_EDGES)


def _one_best(found: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The best row of each group, if no other ties with it."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return found.withColumn("_r", F.rank().over(w)).where("_r = 1").withColumn("_ties", F.count(F.lit(1)).over(Window.partitionBy(by))).where("_ties = 1").drop("_r", "_ties")


def repost_edges(posts: DataFrame) -> DataFrame:
    """(a, b) that connect all posts of near-equal titles: a star of the posts of one set of bigrams, and pairs of such sets.

    Every near-equal pair is connected, though not by an edge of its own; posts without bigrams have none.
    """
    known = posts.where(F.size("bi") > 0).withColumn("_set", F.md5(F.concat_ws("\x01", F.array_sort(F.array_distinct("bi")))))
    least = known.groupBy("_set").agg(F.min_by(F.struct("id", "bi"), "id").alias("_p"))
    stars = known.join(least.select("_set", F.col("_p.id").alias("a")), "_set").where("a <> id").select("a", F.col("id").alias("b"))
    return stars.unionByName(jaccard_pairs(least.select("_p.*"), "id", "bi", DUPLICATE).select("a", "b"))


def cluster(posts: DataFrame, rules: Rules = Rules()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((id, issue) of all posts, repost edges (a, b), idf). issue is the least id of the cluster; loners are their own."""
    idf = cut(token_idf(posts, "id", "kws"))
    strong = idf.where((F.col("df") >= 2) & ~F.col("token").isin(*rules.generic, *rules.link_stop) & (F.char_length("token") >= 2))
    words = cut(posts.select("id", "source", F.explode("kws").alias("token")).join(strong.select("token", "df"), "token").withColumn("number", F.col("token").rlike(NUMBER)))

    # each post's home is one word, so words don't chain
    home = words.groupBy("id").agg(F.max_by("token", F.struct(~F.col("number"), "df", "token")).alias("home"))
    home = cut(home.join(posts.select("id", "bi"), "id"))
    least = F.min("id").over(Window.partitionBy("home"))
    by_word = home.where(~F.col("home").rlike(NUMBER)).select(least.alias("src"), F.col("id").alias("dst"))
    a, b = (home.where(F.col("home").rlike(NUMBER)).select("home", F.col("id").alias(x), F.col("bi").alias(f"b{x}")) for x in ("src", "dst"))
    both = F.size(F.array_intersect("bsrc", "bdst"))
    by_number = a.join(b, "home").where((F.col("src") < F.col("dst")) & (both >= NUMBER_HOME * (F.size("bsrc") + F.size("bdst") - both)) & (both > 0)).select("src", "dst")
    first = cut(by_word.union(by_number).where("src <> dst"))

    homes = home.groupBy("home").agg(F.min("id").alias("first")).where(~F.col("home").rlike(NUMBER))
    among = words.where("NOT number").join(homes.select(F.col("home").alias("token")), "token", "left_semi").groupBy("id").agg(F.collect_set("token").alias("ws"))
    size = lambda x: strong.select(F.col("token").alias(x), F.col("df").alias(f"df_{x}"))
    merged = cooccurrence(among, "ws", MERGE_CO).join(size("a"), "a").join(size("b"), "b").where(F.col("n") / F.least("df_a", "df_b") >= MERGE_SHARE)
    at = lambda x, name: homes.select(F.col("home").alias(x), F.col("first").alias(name))
    merges = merged.join(at("a", "src"), "a").join(at("b", "dst"), "b").select("src", "dst")
    reposts = cut(repost_edges(posts))

    def labelled(edges: DataFrame) -> DataFrame:
        return posts.select("id", "source").join(components(edges).withColumnRenamed("node", "id"), "id", "left").withColumn("issue", F.coalesce("component", "id")).drop("component")

    joined = cut(labelled(first.union(merges).union(reposts)))
    sizes = joined.groupBy("issue").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("source").alias("sources"))
    held = words.join(joined.select("id", "issue"), "id")
    counts = held.groupBy("issue", "token").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("seen"), F.first("number").alias("number")).join(sizes, "issue").where("size >= 2")

    # a loner joins the one cluster that shares most of its words; a cluster of one source the one that its top word meets most
    alone = held.where("NOT number").join(sizes.where("size = 1"), "issue", "left_semi").select("id", "token")
    shared = alone.join(counts.select("token", "issue", "k", "size"), "token").groupBy("id", "issue", "size").agg(F.count(F.lit(1)).alias("sh"), F.sum("k").alias("total"), F.max(F.col("k") / F.col("size")).alias("top"))
    lone = _one_best(shared.where("sh >= 2 OR (size >= 3 AND top >= 0.5)"), "id", ["sh", "total"]).select(F.col("id").alias("src"), F.col("issue").alias("dst"))
    top = counts.groupBy("issue", "size", "sources").agg(F.max_by("token", F.struct("k", -F.col("seen"), "token")).alias("top"))
    tops = words.join(top.select(F.col("top").alias("token")).distinct(), "token", "left_semi").select("id", "token")
    met = tops.withColumnRenamed("token", "x").join(tops.withColumnRenamed("token", "y"), "id").groupBy("x", "y").agg(F.count(F.lit(1)).alias("met"))
    side = lambda x: top.select(F.col("issue").alias(f"{x}_issue"), F.col("size").alias(f"{x}_size"), F.col("sources").alias(f"{x}_sources"), F.col("top").alias(x))
    pairs = met.join(side("x").where("x_sources = 1"), "x").join(side("y").where("y_sources >= 2"), "y").where("x_issue <> y_issue")
    satellites = _one_best(pairs, "x_issue", ["met"]).select(F.col("x_issue").alias("src"), F.col("y_issue").alias("dst"))
    attached = components(lone.union(satellites))
    final = cut(joined.join(attached.withColumnRenamed("node", "issue"), "issue", "left").select("id", "source", F.coalesce("component", "issue").alias("issue")))

    # clusters that are large without a word that half of their posts share fall back to homes
    before = labelled(first).select("id", F.col("issue").alias("home_issue"))
    wide = final.groupBy("issue").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("c")).where((F.col("n") > BIG_POSTS) | (F.col("c") > BIG_SOURCES))
    cover = words.join(final.select("id", "issue"), "id").groupBy("issue", "token").agg(F.count(F.lit(1)).alias("k")).groupBy("issue").agg(F.max("k").alias("k"))
    loose = wide.join(cover, "issue", "left").where(F.coalesce("k", F.lit(0)) / F.col("n") < COHESION).select("issue", F.lit(True).alias("loose"))
    out = final.join(loose, "issue", "left").join(before, "id").select("id", F.when(F.col("loose"), F.col("home_issue")).otherwise(F.col("issue")).alias("issue"))
    return cut(out), reposts, idf


def candidates(posts: DataFrame) -> DataFrame:
    """Posts (issue, id, source, bi, unsafe, why) of which _chosen() chooses as of all: the first of REPS sources of each set of bigrams, safe or not.

    Of posts of one set, a source's later ones go with its first, and where REPS sources' first ones are gone over, REPS are chosen. So what a
    task sorts of an issue grows with its different titles, not with its posts.
    """
    order = [F.desc("_order"), F.asc("id")]
    kept = posts.withColumn("_order", F.col("why") - 3 * F.col("unsafe").cast("int")).withColumn("_set", F.md5(F.concat_ws("\x01", F.array_sort(F.array_distinct("bi")))))
    by = ["issue", "_set", "unsafe"]
    for keys, most in (([*by, "source"], 1), (by, REPS)):
        kept = kept.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_i") <= most).drop("_i")
    return kept.drop("_order", "_set")


def _chosen(pdf: pd.DataFrame) -> pd.DataFrame:
    """Representatives of one issue: by why, one a source, no near copies, unsafe ones only in front; and the first one's title."""
    pdf = pdf.assign(_order=pdf["why"] - 3 * pdf["unsafe"]).sort_values(["_order", "id"], ascending=[False, True], kind="stable")
    chosen: list = []
    for post in pdf.itertuples():
        bi = set(post.bi)
        near = any(bi and set(c.bi) and len(bi & set(c.bi)) / len(bi | set(c.bi)) >= DUPLICATE for c in chosen)
        if len(chosen) < REPS and all(c.source != post.source for c in chosen) and not near and (not chosen or not post.unsafe):
            chosen.append(post)
    return pd.DataFrame({"issue": [pdf["issue"].iloc[0]], "head": [chosen[0].title], "reps": [[int(c.rank) for c in chosen]]})


def explained(core: Column, n: Column, name: Column) -> Column:
    """How well a post (kws, title, comment_share, rank_score) tells its issue: the shares of the first core words (token, k) it has,
    how many, how full its title is, comments and rank; jests and lewd titles less, an event of the name more."""
    had = F.filter(F.slice(core, 1, EXPLAINED), lambda c: F.array_contains("kws", c["token"]))
    cover = F.aggregate(had, F.lit(0.0), lambda total, c: total + c["k"] / n)
    full = F.least(F.char_length(split_title(F.col("title"))["body"]), F.lit(FULL_TITLE)) / FULL_TITLE
    event = F.exists(F.array(*map(F.lit, WHY_EVENTS)), lambda e: F.contains(name, e) & F.contains("title", e))
    bonus = lambda test, worth: F.when(F.coalesce(test, F.lit(False)), worth).otherwise(0.0)
    return cover + 0.35 * F.greatest(F.lit(0), F.size(had) - 1) + full * 0.6 + F.col("comment_share") * 0.2 + F.col("rank_score") / 400 + bonus(event, 0.4) - bonus(F.col("title").rlike(MEME), 1.0) - bonus(F.col("title").rlike(LEWD), 2.0)


def issues(posts: DataFrame, history: DataFrame, as_of: datetime, rules: Rules = Rules()) -> DataFrame:
    """One row for each cluster of two posts or more: counts, times, status, kind, heat, confidence, name, keywords and members' ranks.

    history has (round_no, url_key), rounds numbered from 0, equal rounds collapsed. Deals and posts of the day before (prev_day)
    don't take part.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    posts = posts.where(~F.coalesce(F.col("title").rlike(DEAL), F.lit(False)))
    posts = posts.where("NOT coalesce(prev_day, false)") if "prev_day" in posts.columns else posts
    posts = community_context(posts.withColumnRenamed("id", "arrival")).withColumnRenamed("arrival", "id")
    posts = cut(posts if "toks" in posts.columns else features(posts, rules))
    member, reposts, idf = cluster(posts, rules)
    rounds = history.agg((F.max("round_no") + 1).alias("m")).first().m or 0
    seen = history.groupBy("url_key").agg(F.min("round_no").alias("first_round"), F.collect_set("round_no").alias("in_rounds"))
    joined = cut(posts.join(member, "id").join(seen, "url_key", "left"))
    big = joined.groupBy("issue").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").select("issue")
    joined = cut(joined.join(big, "issue", "left_semi"))

    hours = lambda t: F.timestamp_diff("SECOND", t, now) / 3600
    in_round = lambda r: F.coalesce(F.array_contains("in_rounds", r), F.lit(False))
    late = [rounds - 1, rounds - 4]
    base = joined.groupBy("issue").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"), F.sum("comments").alias("comments"),
        F.sort_array(F.collect_list("rank")).alias("ranks"), F.max("event_ts").alias("last"),
        F.count("event_ts").alias("timed"), F.count_if(hours(F.col("event_ts")) <= 3).alias("recent"),
        F.count_if(~in_round(rounds - 2)).alias("_grew"), F.avg((F.coalesce("first_round", F.lit(rounds)) >= rounds - 2).cast("double")).alias("_fresh"),
        *[F.count_if(in_round(r)).alias(f"_n{i}") for i, r in enumerate(late)], *[F.count_distinct(F.when(in_round(r), F.col("source"))).alias(f"_c{i}") for i, r in enumerate(late)],
        F.min(F.struct(F.coalesce("first_round", F.lit(99)), "url_key")).alias("_anchor"),
    )
    long_run = F.lit(rounds >= 4)
    measured = F.col("_n0"), F.col("_c0"), F.when(long_run, F.col("_n1")), F.when(long_run, F.col("_c1")), F.col("recent"), F.col("n"), hours(F.col("since")), hours(F.col("last")), F.col("timed")
    base = base.join(second_earliest(joined, "issue", "event_ts").select("issue", "first", "since"), "issue", "left")
    base = base.withColumn("status", status(*measured)).withColumn("status_why", status_reason(*measured))

    words = joined.select("issue", F.explode("kws").alias("token")).groupBy("issue", "token").agg(F.count(F.lit(1)).alias("k")).join(idf.select("token", "idf"), "token")
    generic = F.col("token").isin(*rules.generic)
    kept = words.where((F.col("k") >= 2) & ~F.col("token").rlike(NUMBER) & ~F.col("token").rlike(PROFANITY) & ~F.col("token").isin(*rules.adverbs, *rules.link_stop))
    core = kept.groupBy("issue").agg(F.transform(F.array_sort(F.collect_list(F.struct(generic.alias("g"), (-F.col("k")).alias("k"), (-F.col("idf")).alias("i"), "token"))), lambda x: F.struct(x["token"].alias("token"), (-x["k"]).alias("k"), x["g"].alias("g"))).alias("core"))
    own = lambda x: member.select(F.col("id").alias(x), F.col("issue").alias(f"i{x}"))
    inner = reposts.join(own("a"), "a").join(own("b"), "b").where("ia = ib").select("a", "b")
    whole = components(inner.withColumnsRenamed({"a": "src", "b": "dst"})).join(member.withColumnRenamed("id", "node"), "node")
    repost = whole.groupBy("issue").agg(F.count(F.lit(1)).alias("_linked"), F.count_distinct("component").alias("_parts"))
    # two posts that share two words, one of them not general; issues of four posts and more don't ask for it
    small = joined.join(base.where(F.col("n") < SURE_POSTS).select("issue"), "issue", "left_semi").join(words.where("k >= 2").groupBy("issue").agg(F.collect_list("token").alias("_ws")), "issue")
    met = F.array_sort(F.array_intersect("kws", "_ws"))
    duo = F.flatten(F.transform(met, lambda x, i: F.transform(F.slice(met, i + 2, F.size(met)), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    both = small.select("issue", F.explode(duo).alias("p")).where(~(F.col("p.x").isin(*rules.generic) & F.col("p.y").isin(*rules.generic)))
    shares = both.groupBy("issue", "p").agg(F.count(F.lit(1)).alias("_c")).where("_c >= 2").select("issue").distinct().withColumn("_shared", F.lit(True))
    spread = spread_heat(joined, "issue", "source", "rank_score").select("issue", "spread")

    full = base.join(core, "issue", "left").join(repost, "issue", "left").join(shares, "issue", "left").join(spread, "issue").join(naming.neighbours(joined, idf, rules), "issue", "left")
    full = full.withColumn("core", F.coalesce("core", F.array().cast("array<struct<token:string,k:bigint,g:boolean>>")))
    covers = F.transform(F.filter("core", lambda x: ~x["g"]), lambda x: x["k"])
    is_repost = (F.col("_parts") == 1) & (F.col("_linked") == F.col("n"))
    is_topic = (F.col("n") >= 5) & (F.try_element_at(covers, F.lit(1)) / F.col("n") >= 0.6) & (F.coalesce(F.try_element_at(covers, F.lit(2)), F.lit(0)) / F.col("n") <= 0.4) & (F.coalesce("most", F.lit(0)) < 3)
    full = full.withColumn("kind", F.when(is_repost, "repost").when(is_topic, "topic").otherwise("story"))
    fresh = F.when(F.lit(rounds >= 3), F.col("_fresh"))
    full = full.withColumn("heat", F.round(heat(F.col("spread"), fresh, F.col("kind"), F.col("status") == "quiet"), 2))
    specific = F.exists("core", lambda x: ~x["g"])
    sure = (F.col("n") >= SURE_POSTS) | (F.col("kind") == "repost") | F.coalesce("_shared", F.lit(False))
    full = full.withColumn("confident", sure & ((F.col("kind") == "repost") | specific) & (F.col("sources") >= 2))
    full = full.withColumn("grew", F.when(F.lit(rounds >= 3), F.col("_grew"))).withColumn("key", F.substring(F.sha1("_anchor.url_key"), 1, 6))
    full = cut(full.drop("_n0", "_n1", "_c0", "_c1", "_grew", "_fresh", "_anchor", "_linked", "_parts", "_shared", "most"))

    full = cut(full.join(naming.named(full, joined, rules), "issue").drop("pairs"))
    context = joined.join(full.select("issue", "core", "name", F.col("n").alias("_n")), "issue").select("issue", "id", "source", "title", "bi", "rank", F.coalesce(F.col("title").rlike(UNSAFE), F.lit(False)).alias("unsafe"), explained(F.col("core"), F.col("_n"), F.col("name")).alias("why"))
    chosen = candidates(context).groupBy("issue").applyInPandas(_chosen, "issue long, head string, reps array<bigint>")
    per = joined.groupBy("issue", "source").agg(F.count(F.lit(1)).alias("n"), F.min("place").cast("long").alias("best"), F.sum("comments").alias("comments"), F.min("id").alias("_first"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus_n"), "_first", "source", "n", "best", "comments")))
    by_source = per.groupBy("issue").agg(F.transform(listed, lambda x: F.struct(x["source"].alias("source"), x["n"].alias("n"), x["best"].alias("best"), x["comments"].alias("comments"))).alias("by_source"))
    told = full.join(chosen, "issue").join(by_source, "issue")
    others = F.filter("core", lambda c: ~c["g"] & ~F.array_contains("name_words", c["token"]))
    keywords = F.when(F.col("kind") == "repost", F.array().cast("array<string>")).otherwise(F.slice(F.transform(others, lambda c: c["token"]), 1, KEYWORDS))
    return told.withColumns({"name": F.when(F.col("name") != "", F.col("name")).otherwise(naming.headline(F.col("head"))), "keywords": keywords, "core": F.transform("core", lambda c: c["token"])}).drop("head", "name_words")


def board(found: DataFrame, most: int = ITEMS) -> DataFrame:
    """The confident issues by heat, a fixed number of them."""
    return found.where("confident").orderBy(F.desc("heat"), "issue").limit(most)


def hot_list(posts: DataFrame, found: DataFrame, most: int = HOT) -> DataFrame:
    """Safe posts at place 1 or 2 of their source that are in no confident issue, one a source, by share of comments."""
    inside = found.where("confident").select(F.explode("ranks").alias("rank"))
    free = community_context(posts.withColumnRenamed("id", "arrival")).where("place <= 2").where(~F.coalesce(F.col("title").rlike(UNSAFE), F.lit(False))).join(inside, "rank", "left_anti")
    score: Column = F.col("comment_share") + (F.col("place") == 1).cast("int") + F.col("comments") / 1000
    best = free.withColumn("score", score).withColumn("_i", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "arrival"))).where("_i = 1")
    return best.orderBy(F.desc("score"), "arrival").limit(most).drop("_i")


#: Fixed value: posts under which a board says that there are few.
LOW_DATA_POSTS = 350
#: What a site shows of an issue.
ITEM = {
    "issue": "bigint", "key": "string", "name": "string", "kind": "string", "status": "string", "status_why": "string", "n": "bigint", "sources": "bigint", "comments": "bigint", "grew": "bigint",
    "first": "timestamp_ntz", "since": "timestamp_ntz", "last": "timestamp_ntz", "heat": "double", "reps": "array<bigint>", "ranks": "array<bigint>",
    "by_source": "array<struct<source:string,n:bigint,best:bigint,comments:bigint>>", "keywords": "array<string>",
}
_ITEM = f"struct<{','.join(f'{k}:{v}' for k, v in ITEM.items())}>"


def block(posts: DataFrame, found: DataFrame | None, rounds: int, as_of: datetime) -> DataFrame:
    """One row, what a site shows: as_of, posts, communities, in_issues, low_data, badges, items (the board, hottest first), hot (ranks).

    posts are all posts of the round, deals and those of the day before among them; found is what issues() gives, or None where it failed: the
    block then has no items and no badges. badges say whether rounds suffice to tell what's new. items and hot have fixed lengths.
    """
    counts = posts.agg(F.count(F.lit(1)).alias("posts"), F.count_distinct("source").alias("communities"))
    made = counts.select(F.lit(as_of).cast("timestamp_ntz").alias("as_of"), "posts", "communities", (F.col("posts") < LOW_DATA_POSTS).alias("low_data"))
    if found is None:
        none = [F.lit(0).cast("long").alias("in_issues"), F.lit(False).alias("badges"), F.array().cast(f"array<{_ITEM}>").alias("items"), F.array().cast("array<bigint>").alias("hot")]
        return made.select("as_of", "posts", "communities", "low_data", *none)
    shown = cut(board(found))
    items = shown.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("heat")).alias("h"), F.col("issue").alias("i"), F.struct(*ITEM).alias("x")))), lambda v: v["x"].cast(_ITEM)).alias("x"))
    ranks = shown.select(F.explode("ranks").alias("rank")).agg(F.count_distinct("rank").alias("x"))
    listed = hot_list(posts, found).withColumn("_o", F.row_number().over(Window.orderBy(F.desc("score"), "arrival")))
    hot = listed.agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", F.col("rank").cast("long").alias("rank")))), lambda v: v["rank"]).alias("x"))
    return made.select("as_of", "posts", "communities", "low_data", ranks.scalar().alias("in_issues"), F.lit(rounds >= 3).alias("badges"), items.scalar().alias("items"), hot.scalar().alias("hot"))
