"""Fixed values of the language and of names: word lists, stated plainly in their natural order."""

# All of this module.

#: Endings that are cut from a word, the longest that fits.
ENDINGS = (
    "하더라구요", "더라구요", "더라고요", "가보셨어요", "셨어요", "았어요", "었어요", "겠어요", "겠습니다", "합니다", "습니다", "됩니다", "입니다", "이에요", "아요", "어요", "네요", "군요", "더라고", "더라구",
    "는데요", "인데요", "은데요", "했어요", "봤어요", "왔어요", "아버린", "어버린", "라버린", "아버려", "어버려", "버린", "버려", "으려고", "려고", "라고", "이라고", "는지", "은지", "을지", "ㄹ지", "면서",
    "으면서", "이다", "하다", "됐다", "했다", "같다", "싶다", "지만", "지는", "으로", "에서", "에게", "한테", "처럼", "만큼", "보다", "까지", "부터", "이며", "이고", "이랑", "이죠", "이요", "는걸",
    "은걸", "ㄴ걸", "는게", "은게", "ㄴ게", "았던", "었던", "던", "았", "었",
)

#: A city that ends like one.
KEEP = (
    "런던",
)

#: Particles of one syllable.
PARTICLES = (
    "이", "가", "은", "는", "을", "를", "에", "의", "와", "과", "로", "도", "만", "들", "랑",
)

#: Those that go even if the stem isn't a word of its own.
ALWAYS = (
    "에", "을", "를", "는", "와", "들",
)

#: Nouns that end like a predicate.
NOUNS_IN_GO = (
    "냉장고", "광고", "창고", "재고", "경고", "신고", "최고", "사고", "보고서",
)

#: Syllables within predicates.
PREDICATE_IN = (
    "했", "됐", "였", "었", "았", "겠", "싶", "같", "있", "없", "않",
)

#: Endings of predicates.
PREDICATE_END = (
    "다", "요", "죠", "네", "냐", "니", "까", "래", "대요", "래요", "세요", "군", "구나", "더라", "더니", "는데", "은데", "던데", "니까", "려고", "려는", "면서", "지만", "고요", "거든", "하는",
    "하던", "하게", "하고", "해서", "하며", "하면", "하려", "한테", "해야", "해줘", "해봐", "하자", "하니", "된", "되는", "되고", "될", "됨", "함", "싶은", "싶어",
)

#: Last syllables of longer ones that no ending was cut from.
PREDICATE_LAST = (
    "고", "던", "린", "른", "며", "게", "서", "지",
)

#: Adverbs and words of titles about titles.
ADVERBS = (
    "제대로", "점점", "보고", "좀", "다시", "많이", "진짜로", "같이", "겨우", "엄청", "아직도", "이제", "걍", "딱", "또", "막", "왜", "뭐", "잘", "못", "안", "다", "단", "근데", "나도", "저도",
    "제가", "내가", "너네", "님들", "저희", "이거", "저거", "그짝", "무조건", "솔직한", "정말로", "아주", "결국", "수준", "근황", "최신", "실시간", "공식", "실제", "이유", "장면", "상황", "반응",
    "후기", "결론", "정체", "요즘", "오늘자", "전국민이", "유일한", "있었다", "좋다", "싶은", "누가", "누구", "이상한",
)

#: Tags that name no thing.
TAG_STOP = (
    "약혐", "혐", "스포", "스포x", "스포?", "ㅇㅎ", "후방", "펌", "블라", "속보", "단독", "안내", "공지", "속보/교도", "정보", "유머", "재업", "포텐대비 재업", "그림", "네이버", "스토브", "네이버페이",
    "한국닌텐도", "애플tv스토어", "추측", "수정", "인터뷰③", "헬시타임", "정치", "펌글",
)

#: Latin words that are never kept.
LATIN_STOP = (
    "JPG", "GIF", "MP4", "TXT", "SNS", "TOP", "TMI", "OK", "VS", "FEAT",
)

#: Words that tie no titles.
LINK_STOP = (
    "사태", "난리", "대형", "대형사고", "충격", "역대", "최악", "긴급", "속보", "단독", "현재", "오늘", "어제", "방금", "논란", "사건", "사고", "의혹", "근황", "상황", "결말", "정리", "요약",
)

#: Events that end a name, in the order in which one of several is taken.
EVENTS = (
    "사건", "사고", "논란", "폭발", "의혹", "사과", "발언", "제재", "해고", "폭로", "열애", "결혼", "은퇴", "사망", "구속", "체포", "출시", "인상", "파업", "우승", "탈락", "공지",
)

#: Suffixes that a name's words lose.
SUFFIXES = (
    "이라면", "에게서", "에게", "에서", "한테", "라면", "들",
)

#: Words that no name has.
NAME_STOP = (
    "만에", "의외로", "떠나", "피셜", "오피셜", "보내", "당신", "실수", "인생", "진짜", "레알", "빡친", "빡침", "올린", "대단한", "충격적인", "절대", "역시", "드디어", "결국", "아직", "방금", "현재",
)

#: Endings of modifiers.
MODIFIER_ENDS = (
    "적인", "스러운", "다", "한", "된", "친", "린", "낸", "던", "는",
)

#: Nouns that end like one.
MODIFIER_KEEP = (
    "북한", "남한", "대한", "제한", "권한", "기한", "무한", "시한", "국한", "한한", "남친", "여친", "사친", "부친", "모친", "절친", "런던", "베를린", "바다", "캐나다", "사다리", "판다", "플로리다",
    "다다",
)

#: Particles that a name's words lose.
NAME_PARTICLES = (
    "은", "는", "이", "가", "을", "를", "에", "의",
)

#: Particles after a normal form.
CASE_PARTICLES = (
    "은", "는", "이", "가", "을", "를", "에", "의", "도", "로", "와", "과", "만",
)

#: General words that may stand at an end of a name all the same, beside events.
EDGE_WORDS = (
    "베트남", "필리핀", "태국", "대만", "홍콩", "러시아", "우크라이나", "북한", "영국", "프랑스", "독일", "인도", "호주", "캐나다", "이스라엘", "이란", "튀르키예", "터키", "몽골", "인도네시아", "말레이시아",
    "브라질", "멕시코", "싱가포르", "런던", "미국", "일본", "중국", "한국", "대통령",
)

#: Events that a title may explain.
WHY_EVENTS = (
    "사건", "사고", "논란", "의혹", "폭발", "사과문", "사과", "지지율", "부상", "은퇴", "열애", "결혼", "사망", "구속", "기소", "체포", "탈퇴", "해체", "출시", "먹튀", "난동", "폭행", "출현", "반전",
)
