"""Labels, lookup tables, defaults, messages and search phrases."""

# Diary moods, in display order.
JOY, SADNESS, ANGER, ANXIETY, NEUTRAL = "기쁨", "슬픔", "분노", "불안", "중립"
LETHARGY = "무기력"
DIARY_EMOTIONS = [JOY, SADNESS, ANGER, ANXIETY, NEUTRAL]

# Moods that have recommendations, in catalogue order.
CATALOGUE_EMOTIONS = [JOY, SADNESS, ANGER, ANXIETY, LETHARGY]

CATEGORIES = ["MUSIC", "MOVIE", "BOOK", "ACTIVITY", "HOBBY"]
PROVIDERS = ["LOCAL", "GOOGLE", "KAKAO", "NAVER"]
ACTIVE, DELETED = "ACTIVE", "DELETED"

# Which mood wins a tie for the dominant one, first to last.
DOMINANT_ORDER = [SADNESS, ANGER, NEUTRAL, ANXIETY, JOY]

# The order in which a harvest visits the moods.
HARVEST_ORDER = [SADNESS, ANGER, ANXIETY, JOY, LETHARGY]

# The two orders in which the four sources are harvested.
FULL_RUN = ["MUSIC", "BOOK", "MOVIE", "ACTIVITY"]
DAILY_THEN_WEEKLY_RUN = ["MOVIE", "BOOK", "ACTIVITY", "MUSIC"]

# Emoji of a mood and icon of a category, with fallbacks.
EMOTION_EMOJI = {JOY: "😊", SADNESS: "😢", ANGER: "😡", ANXIETY: "😰", NEUTRAL: "😐"}
DEFAULT_EMOJI = "🙂"
# The shorter emoji table of the statistics dashboard.
DASHBOARD_EMOJI = {JOY: "😊", SADNESS: "😢", ANGER: "😡", NEUTRAL: "😐"}
CATEGORY_ICON = {"MUSIC": "🎵", "MOVIE": "🎬", "BOOK": "📚", "ACTIVITY": "🏃", "HOBBY": "🎨"}
DEFAULT_ICON = "📌"

# Weekday names, Sunday first.
WEEKDAYS = ["일", "월", "화", "수", "목", "금", "토"]

# What a failed classification stores.
DEFAULT_EMOTION, DEFAULT_SCORE = NEUTRAL, 0.0

# Keyword rules of the keyword classifier, tried in order.
POSITIVE_KEYWORDS = ["좋아", "행복", "맑아"]
NEGATIVE_KEYWORDS = ["슬퍼", "화나", "짜증"]
KEYWORD_RULES = [(JOY, POSITIVE_KEYWORDS), (SADNESS, NEGATIVE_KEYWORDS)]

# Texts standing in for parts a result page lacks.
NO_AUTHOR = "저자 정보 없음"
NO_DESCRIPTION = "설명 정보 없음"
NO_SYNOPSIS = "줄거리 정보 없음"
NO_VIDEO_DESCRIPTION = "YouTube 공식 음원"
AUTHOR_PREFIX = "저자: "

# Address patterns of the harvested sites.
WATCH_PREFIX = "https://www.youtube.com/watch?v="
MOVIE_SEARCH_PREFIX = "https://search.daum.net/search?w=tot&q="
MOVIE_SEARCH_SUFFIX = "+영화"

# Search address of each source around the encoded phrase.
# The video one carries no key: the fetcher adds it.
SEARCH_ADDRESS = {
    "MUSIC": ("/search?part=snippet&maxResults=50&q=", "&type=video"),
    "BOOK": ("https://search.kyobobook.co.kr/search?keyword=", ""),
    "MOVIE": (MOVIE_SEARCH_PREFIX, MOVIE_SEARCH_SUFFIX),
    "ACTIVITY": ("https://search.daum.net/search?w=tot&q=", ""),
}

# Column widths of the catalogue and snippet lengths of the sources.
TITLE_LIMIT, DESCRIPTION_LIMIT, URL_LIMIT = 200, 1000, 500
BOOK_SNIPPET, MOVIE_SNIPPET, ACTIVITY_SNIPPET = 100, 100, 80
SHORT_TITLE = 5

# Messages of the input rules.
DIARY_CONTENT_REQUIRED = "일기 내용을 입력해 주세요."
EMAIL_REQUIRED = "이메일은 필수 입력값입니다."
EMAIL_FORMAT = "올바른 이메일 형식이 아닙니다."
PASSWORD_REQUIRED = "비밀번호는 필수 입력값입니다."
PASSWORD_LENGTH = "비밀번호는 8자 이상 20자 이하로 입력해주세요."
PASSWORD_PATTERN = "비밀번호는 영문, 숫자, 특수문자를 각각 1개 이상 포함해야 합니다."
NICKNAME_REQUIRED = "닉네임은 필수 입력값입니다."
NICKNAME_LENGTH = "닉네임은 2자 이상 20자 이하로 입력해주세요."
LOGIN_EMAIL_REQUIRED = "이메일을 입력해 주세요."
LOGIN_PASSWORD_REQUIRED = "비밀번호를 입력해 주세요."
TEXT_REQUIRED = "'text' 값이 비어 있습니다."

# Search phrases of the book and movie harvests.
STORY_PHRASES = {JOY: ["코미디"], SADNESS: ["감동"], ANGER: ["액션"], ANXIETY: ["힐링"], LETHARGY: ["인생"]}

# Search phrases of the activity harvest.
ACTIVITY_PHRASES = {
    JOY: ["친구와 즐기기 좋은 야외 활동"],
    SADNESS: ["혼자 사색하기 좋은 산책 코스"],
    ANGER: ["스트레스 풀리는 고강도 운동"],
    ANXIETY: ["마음 안정을 돕는 명상과 요가"],
    LETHARGY: ["성취감을 주는 작은 취미 활동"],
}

# Search phrases of the music harvest, twenty to a mood.
MUSIC_PHRASES = {
    JOY: [
        "기분 좋아지는 노래 플레이리스트", "기분 좋아지는 노래 공식 음원", "신나는 노래 플레이리스트",
        "행복한 노래 모음", "기분 전환 좋은 노래", "웃음 나는 노래 모음", "댄스 파티 음악",
        "업템포 노래 모음", "기분 좋은 아침 음악", "즐거운 여행 음악", "취향저격 노래",
        "힙한 노래 모음", "팝송 플레이리스트", "K-pop 히트곡", "트렌디한 노래",
        "댄스곡 모음", "파티 음악", "춤추고 싶은 노래", "신나는 팝송", "기분 좋은 팝",
    ],
    SADNESS: [
        "울고 싶은 노래 플레이리스트", "감성 발라드 모음", "슬픈 노래 공식 음원",
        "마음이 차분해지는 음악", "한숨 나오는 노래 모음", "잔잔한 피아노 음악", "우울할 때 듣는 노래",
        "마음 위로 되는 노래", "감성적인 노래 모음", "눈물 나는 노래 플레이리스트", "슬픈 발라드",
        "가사 좋은 노래", "마음이 찡한 노래", "한곡만 듣고 싶은 노래", "감성 음악",
        "아픈 노래 모음", "이별 노래", "추억 노래", "노래방 슬픈 곡", "마음 위로 곡",
    ],
    ANGER: [
        "분노 해소 음악 플레이리스트", "록 음악 모음", "메탈 음악 공식 음원",
        "스트레스 풀리는 노래", "고음질 록 음악", "에너지 넘치는 노래", "힘나는 노래 모음",
        "격렬한 음악 플레이리스트", "노래방 추천 곡", "힘내는 노래 모음", "록 발라드",
        "메탈 곡 모음", "히트곡 모음", "강렬한 노래", "에너지 충전 음악",
        "노래방 록곡", "힘내는 발라드", "격렬한 팝송", "록 앤롤", "하드록 곡",
    ],
    ANXIETY: [
        "불안할 때 듣는 음악", "차분한 음악 플레이리스트", "명상 음악 공식 음원",
        "마음 안정되는 노래", "집중력 향상 음악", "스스로 진정되는 노래", "평온한 음악 모음",
        "힐링 음악 플레이리스트", "잔잔한 자연 소리", "마음 챙김 음악", "클래식 음악",
        "피아노 곡 모음", "재즈 플레이리스트", "아코디언 음악", "어쿠스틱 곡",
        "잔잔한 팝송", "차분한 발라드", "명상용 음악", "요가 음악", "수면 음악",
    ],
    LETHARGY: [
        "기분 전환에 좋은 가벼운 음악", "부드러운 재즈 플레이리스트", "Lo-fi 음악 모음",
        "취미 생활 추천 음악", "작은 성취감 주는 노래", "일상 속 작은 행복", "가벼운 팝 음악",
        "여유로운 오후 음악", "집중력 도움 음악", "작은 목표 달성 음악", "인디 음악",
        "포크 곡 모음", "어쿠스틱 팝", "가벼운 발라드", "일상 음악",
        "작은 행복 노래", "평온한 곡", "일상 속 음악", "취미 음악", "집중 음악",
    ],
}

# Search phrases of the older, untrimmed music harvest, five to a mood.
MUSIC_RAW_PHRASES = {
    JOY: [
        "기분 좋아지는 신나는 노래", "happy kpop playlist", "upbeat pop songs 2024",
        "dance party music", "cheerful songs to lift your mood",
    ],
    SADNESS: [
        "우울할 때 듣는 잔잔한 노래", "sad ballads to cry to", "healing acoustic music",
        "감성 발라드 모음", "calm piano music for sadness",
    ],
    ANGER: [
        "분노 해소 록 음악", "heavy metal workout music", "rage rock songs",
        "aggressive music to release anger", "hardcore punk playlist",
    ],
    ANXIETY: [
        "불안할 때 듣는 차분한 음악", "calming meditation music", "relaxing ambient sounds",
        "stress relief music", "peaceful nature sounds",
    ],
    LETHARGY: [
        "기분 전환에 좋은 가벼운 음악", "light jazz for relaxation", "easy listening music",
        "부드러운 재즈 플레이리스트", "chill lofi beats to study to",
    ],
}

PHRASES = {
    "MUSIC": MUSIC_PHRASES,
    "MUSIC_RAW": MUSIC_RAW_PHRASES,
    "BOOK": STORY_PHRASES,
    "MOVIE": STORY_PHRASES,
    "ACTIVITY": ACTIVITY_PHRASES,
}
