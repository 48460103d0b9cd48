"""Titles on hand-written values."""

from pyspark.sql import functions as F

from tidemark.functions import titles

RULES = titles.Rules(generic=("여자", "대통령"), stop=("사진",))


def test_split(spark):
    cases = [("[싱갤] 배그) 축구 논란.jpg ㅋㅋ", "축구 논란", ["싱갤", "배그"]), ("그냥  제목", "그냥 제목", []), ("【 속보 】", "", ["속보"]), (None, "", []), ("", "", [])]
    frame = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    assert [(r.p.body, r.p.tags) for r in frame.select("i", titles.split_title(F.col("t")).alias("p")).orderBy("i").collect()] == [c[1:] for c in cases]
    assert frame.limit(1).select(titles.spelled_out(F.lit("李 대통령, 尹 전 대통령과 與")).alias("o")).first().o == "이재명 대통령, 윤석열 대통령과 여당 "


def test_stem(spark):
    cases = {"학교에서": "학교", "런던": "런던", "명절에": "명절", "친구한테": "친구", "삼성": "삼성", "축구였던": "축구였", "좋겠습니다": "좋"}
    frame = spark.createDataFrame([(w,) for w in cases], "w string")
    assert {r.w: r.s for r in frame.select("w", titles.stem(F.col("w")).alias("s")).collect()} == cases


def test_tokens(spark):
    row = spark.createDataFrame([("[야갤][속보] 손흥민 골 넣었다 EPL JPG 20%할인 2.5배 삼성냉장고 확인하고 사진",)], "t string")
    got = row.select(titles.tokens(titles.split_title(F.col("t")), RULES).alias("t")).first().t
    assert [(t.surface, t.norm, t.kind) for t in got] == [
        ("야갤", "야갤", "B"), ("속보", "속보", "S"), ("손흥민", "손흥민", "N"), ("골", "골", "S"), ("넣었다", "넣었다", "P"), ("EPL", "EPL", "L"), ("JPG", "JPG", "S"), ("20", "20", "D"), ("할인", "할인", "N"),
        ("2.5배", "2.5배", "D"), ("삼성냉장고", "삼성냉장고", "P"), ("확인하고", "확인하고", "P"), ("사진", "사진", "S"),
    ]


def test_features(spark):
    rows = [(1, "배그가 삼성냉장고 샀다"), (2, "PUBG 삼성 소식"), (3, "삼성 냉장고 40대"), (4, "냉장고 여자의 배그"), (5, None), (6, "")]
    posts = spark.createDataFrame([(*r, "x") for r in rows], "id long, title string, w string")
    got = {r.id: r for r in titles.features(posts, RULES).collect()}
    kws = {i: set(r.kws) for i, r in got.items()}
    assert kws == {1: {"배그", "삼성냉장고", "삼성", "냉장고"}, 2: {"배그", "삼성", "소식"}, 3: {"삼성", "냉장고", "40대"}, 4: {"냉장고", "여자", "배그"}, 5: set(), 6: set()}
    assert got[1].w == "x" and got[5].bi == [] and [t.norm for t in got[3].toks] == ["삼성", "냉장고", "40대"]
    assert titles.features(posts.limit(0)).count() == 0


def test_features_of_equal_titles(spark):
    rows = [(1, "삼성냉장고 샀다"), (2, "삼성 소식"), (3, "삼성 소식"), (4, "냉장고 소식"), (5, "냉장고 소식"), (6, None), (7, None)]
    got = {r.id: set(r.kws) for r in titles.features(spark.createDataFrame(rows, "id long, title string"), RULES).collect()}
    assert len(got) == 7 and got[1] == {"삼성냉장고", "삼성", "냉장고"} and got[2] == got[3] and got[6] == got[7] == set()
