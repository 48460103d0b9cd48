"""Korean titles: what is a tag, a noun, a predicate or a number, and the words that tie titles together."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed_words as words
from tidemark.functions.text import bigrams
from tidemark.session import cut

# Fixed values of the language's rules: words from fixed_words, patterns here.
ENDINGS, KEEP, NOUNS_IN_GO, PREDICATE_END = words.ENDINGS, words.KEEP, words.NOUNS_IN_GO, words.PREDICATE_END
PARTICLES, ALWAYS, PREDICATE_IN, PREDICATE_LAST = ("".join(x) for x in (words.PARTICLES, words.ALWAYS, words.PREDICATE_IN, words.PREDICATE_LAST))
#: Tags of boards, marks of files, counts that tie titles, and Chinese characters that stand for names.
BOARD = r"^(?:[가-힣]{1,3}갤|싱글벙글)$"
FILE_MARK = r"(?i)\.+\s*(?:jpg|jpeg|jpf|gif|png|mp4|twt|txt|manhwa|webp|avi|mov)\b"
TAG, HEAD_TAG = r"[\[【]([^\]】]{1,14})[\]】]", r"^\s*([가-힣A-Za-z0-9?]{1,6})\)\s*"
JAMO = "[ㄱ-ㅎㅏ-ㅣ]+"
COUNTED = r"([0-9]+(?:개월|살|대|kg|km))"
HANJA = ((r"李\s*대통령", "이재명 대통령"), (r"尹\s*(?:전\s*)?대통령", "윤석열 대통령"), (r"文\s*(?:전\s*)?대통령", "문재인 대통령"), ("與", "여당 "), ("野", "야당 "))
ALIAS = {"PUBG": "배그", "펍지": "배그", "배틀그라운드": "배그", "TANVUU": "탄부", "방플러": "방플", "마운자": "마운자로"}
ADVERBS, TAG_STOP, LATIN_STOP, LINK_STOP = words.ADVERBS, words.TAG_STOP, words.LATIN_STOP, words.LINK_STOP
#: Words too general to tie titles alone, and words that are never kept. Long lists belong to a site; these are this library's own.
GENERIC = ("news", "today", "video", "people", "photo", "오늘", "사람", "근황", "후기", "영상", "사진", "한국", "미국", "일본", "중국", "대통령", "정부", "게임", "영화", "논란")
STOP = ("종합", "기자", "뉴스", "공유", "추천", "출처", "대박", "인정", "공감", "레전드", "완료", "진행", "시작", "확인")


@dataclass(frozen=True)
class Rules:
    """Word lists; a site's own take the place of the short ones here."""

    generic: tuple[str, ...] = GENERIC
    stop: tuple[str, ...] = STOP
    adverbs: tuple[str, ...] = ADVERBS
    tag_stop: tuple[str, ...] = TAG_STOP
    latin_stop: tuple[str, ...] = LATIN_STOP
    link_stop: tuple[str, ...] = LINK_STOP
    alias: dict = field(default_factory=lambda: dict(ALIAS))


def _let(value: Column, body) -> Column:
    """body of a value that is computed once a row."""
    return F.transform(F.array(value), body)[0]


def spelled_out(title: Column) -> Column:
    """Title with names for the Chinese characters that stand for them."""
    for pattern, name in HANJA:
        title = F.regexp_replace(title, pattern, name)
    return title


def split_title(title: Column) -> Column:
    """struct<body, tags>: tags in brackets, and one before a closing parenthesis at the head; the body has neither them nor marks
    of files nor single jamo. Null is an empty title."""
    plain = F.coalesce(title, F.lit(""))
    inside = F.transform(F.regexp_extract_all(plain, F.lit(TAG), F.lit(1)), lambda t: F.trim(t))

    def made(rest: Column) -> Column:
        head = F.regexp_extract(rest, HEAD_TAG, 1)
        body = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, HEAD_TAG, ""), FILE_MARK, " "), JAMO, " ")
        tags = F.concat(inside, F.when(head != "", F.array(head)).otherwise(F.array().cast("array<string>")))
        return F.struct(F.trim(F.regexp_replace(body, r"\s+", " ")).alias("body"), tags.alias("tags"))

    return _let(F.regexp_replace(plain, TAG, " "), made)


def stem(word: Column) -> Column:
    """A word without its ending, and without a particle that always goes if three syllables are there."""
    bare = F.regexp_replace(word, f"(?:{'|'.join(sorted(ENDINGS, key=len, reverse=True))})$", "")
    cut = _let(bare, lambda s: F.when((F.char_length(s) >= 3) & s.rlike(f"[{ALWAYS}]$"), F.left(s, F.char_length(s) - 1)).otherwise(s))
    return F.when(word.isin(*KEEP), word).otherwise(cut)


def _token(surface: Column, norm: Column, kind) -> Column:
    return F.struct(surface.alias("surface"), norm.alias("norm"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"))


def _hangul(w: Column, rules: Rules) -> Column:
    def of(s: Column) -> Column:
        dull = (F.char_length(s) < 2) | w.isin(*rules.stop, *rules.adverbs) | s.isin(*rules.stop, *rules.adverbs)
        told = w.rlike(f"[{PREDICATE_IN}]") | w.rlike(f"(?:{'|'.join(PREDICATE_END)})$") | ((F.char_length(w) >= 3) & (w == s) & w.rlike(f"[{PREDICATE_LAST}]$"))
        return _token(w, F.when(w.rlike(BOARD), w).otherwise(s), F.when(w.rlike(BOARD), "B").when(dull, "S").when(told, "P").otherwise("N"))

    return _let(stem(w), of)


def tokens(parts: Column, rules: Rules) -> Column:
    """array<struct<surface, norm, kind>> of split_title(): tags first. Kinds: N a noun, L Latin, D a number, P a predicate, B a board,
    S a word that says nothing."""
    pieces = F.regexp_extract_all(parts["body"], F.lit(r"([가-힣]+|[A-Za-z][A-Za-z0-9-]*|[0-9]+(?:\.[0-9]+)?[가-힣]*)"), F.lit(1))
    of_tag = lambda t: _token(t, t, F.when(t.rlike(BOARD), "B").when(t.isin(*rules.tag_stop) | F.lower(t).isin(*rules.tag_stop), "S").otherwise("N"))

    def of_piece(p: Column) -> Column:
        upper = F.upper(p)
        latin = _token(p, upper, F.when((F.char_length(p) < 2) | upper.isin(*rules.latin_stop), "S").otherwise("L"))
        return F.when(p.rlike("^[A-Za-z]"), latin).when(p.rlike("^[0-9]"), _token(p, p, "D")).otherwise(_hangul(p, rules))

    return F.concat(F.transform(parts["tags"], of_tag), F.transform(pieces, of_piece))


def features(posts: DataFrame, rules: Rules = Rules(), title: str = "title") -> DataFrame:
    """posts with body, bi, toks (array<struct<surface, norm, kind>>, boards left out) and kws, the words that tie them.

    A word that ends in a particle is its stem where that is a noun of some title; a long word also counts as its two parts where
    both are words of two posts' titles or more. Posts of one title have the same, so what's made of a title is made once. Vocabularies are
    tables joined by word, never held by one task.
    """
    key = "_title"
    different = posts.groupBy(F.col(title).alias(key)).agg(F.count(F.lit(1)).alias("_posts"))
    parts = different.select(key, "_posts", split_title(spelled_out(F.col(key))).alias("_p"), F.regexp_extract_all(spelled_out(F.coalesce(key, F.lit(""))), F.lit(COUNTED), F.lit(1)).alias("_counted"))
    made = cut(parts.select(key, "_posts", "_counted", F.col("_p.body").alias("body"), tokens(F.col("_p"), rules).alias("_t")))
    each = made.select(key, F.posexplode("_t").alias("_at", "_t")).select(key, "_at", "_t.*")

    nouns = each.where("kind = 'N'").select("norm").distinct()
    ends = F.left("norm", F.char_length("norm") - 1)
    longer = nouns.where((F.char_length("norm") >= 3) & F.col("norm").rlike(f"[{PARTICLES}]$")).select("norm", ends.alias("_stem"))
    merged = longer.join(nouns.select(F.col("norm").alias("_stem")), "_stem")
    norm = F.coalesce("_stem", "norm")
    is_noun_in_go = (F.col("kind") == "P") & F.col("surface").rlike(f"(?:{'|'.join(NOUNS_IN_GO)})$")
    told = each.join(merged, "norm", "left").where("kind <> 'B'").select(
        key, "_at", "surface", F.when(is_noun_in_go, F.col("surface")).otherwise(norm).alias("norm"), F.when(is_noun_in_go, "N").otherwise(F.col("kind")).alias("kind")
    )
    short = F.left("norm", F.char_length("norm") - 1)
    plain = (F.col("kind") == "N") & (F.char_length("norm") >= 3) & F.col("norm").rlike(f"[{PARTICLES}]$") & short.isin(*rules.generic, *rules.stop)
    told = told.withColumn("norm", F.when(plain, short).otherwise(F.col("norm")))
    if rules.alias:
        names = F.create_map(*[F.lit(x) for pair in rules.alias.items() for x in pair])
        told = told.withColumn("norm", F.coalesce(F.try_element_at(names, F.col("norm")), "norm"))
    listed = told.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "surface", "norm", "kind"))), lambda t: F.struct(t["surface"].alias("surface"), t["norm"].alias("norm"), t["kind"].alias("kind"))).alias("toks"))

    tying = lambda t: t["kind"].isin("N", "L") & (F.char_length(t["norm"]) >= 2) & ~t["norm"].rlike(BOARD) & ~t["norm"].isin(*rules.stop)
    none = F.array().cast("array<struct<surface:string,norm:string,kind:string>>")
    known = made.select(key, "_posts", "body", "_counted").join(listed, key, "left").withColumn("toks", F.coalesce("toks", none))
    known = known.withColumn("_kws", F.array_distinct(F.concat(F.transform(F.filter("toks", tying), lambda t: t["norm"]), "_counted")))

    words = known.select(key, "_posts", F.explode("_kws").alias("w"))
    df = words.groupBy("w").agg(F.sum("_posts").alias("df"))
    half = df.where((F.col("df") >= 2) & ~F.col("w").isin(*rules.generic)).select("w")
    long = df.where((F.char_length("w") >= 4) & F.col("w").rlike("^[가-힣]+$")).select("w", F.explode(F.sequence(F.lit(2), F.char_length("w") - 2)).alias("_cut"))
    cuts = long.select("w", "_cut", F.left("w", F.col("_cut")).alias("_a"), F.substring("w", F.col("_cut") + 1, F.char_length("w")).alias("_b"))
    both = cuts.join(half.select(F.col("w").alias("_a")), "_a").join(half.select(F.col("w").alias("_b")), "_b")
    first = both.groupBy("w").agg(F.min_by(F.array("_a", "_b"), "_cut").alias("_ab"))
    added = words.join(first, "w").groupBy(key).agg(F.flatten(F.collect_list("_ab")).alias("_add"))
    out = known.join(added, key, "left").select(key, "body", "toks", F.array_sort(F.array_distinct(F.concat("_kws", F.coalesce("_add", F.array().cast("array<string>"))))).alias("kws"))
    out = out.withColumn("bi", bigrams(F.col("body")))
    return posts.drop("body", "toks", "kws", "bi").join(out, F.col(title).eqNullSafe(F.col(key))).drop(key)
