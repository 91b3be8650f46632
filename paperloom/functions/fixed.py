"""Word lists, prompts, tables and phrases that results depend on, as plain text."""

from __future__ import annotations

#: Keywords of each exam domain, in declared order; one of them is listed twice and counts twice.
DOMAIN_KEYWORDS = {
    "한국사": (
        "현종실록", "고려사", "삼국사기", "조선", "고려", "신라", "백제", "고구려",
        "임진왜란", "병자호란", "갑오개혁", "을사조약", "독립군", "광복", "일제",
        "붕당", "탕평", "과거", "전시과", "노비안검법", "전민변정도감", "12목",
        "만민공동회", "헌의 6조", "홍범 14조", "국채보상운동", "방곡령",
    ),
    "서양사/철학": (
        "볼테르", "계몽주의", "베이컨", "코페르니쿠스", "에라스무스", "낭만주의",
        "리스본 지진", "프랑스", "영국", "독일", "러시아", "스페인", "이탈리아",
        "르네상스", "종교개혁", "프로테스탄트", "가톨릭", "낭트 칙령", "카를스바트",
        "농노제", "알렉산드르", "스톨리핀", "애디슨 법", "스펜서", "푸리에",
        "메테르니히", "마치니", "비오 9세",
    ),
    "경제": (
        "케인스", "통화", "인플레이션", "gdp", "금리", "대출", "공급", "수요",
        "균형", "물가", "실업률", "소득", "세금", "지출", "생산량", "시장",
        "가격", "비용", "이윤", "효용", "한계 효용", "자유방임", "상업주의",
        "중금주의", "산업화", "모직물", "기계", "노동자", "임금",
    ),
    "심리학": (
        "파블로프", "조건화", "심리학", "기억", "학습", "동기", "감정", "인지",
        "행동", "실험", "변수", "타당도", "신뢰도", "설득", "인식", "인지",
        "변연계", "시상", "연수", "소뇌", "단순노출효과", "체계적 둔감화",
    ),
}
GENERAL_DOMAIN = "일반 독해"

#: The text before retrieved documents, and the title of one that has none.
CONTEXT_PREFACE = (
    "아래는 문제 해결을 위해 검색된 배경지식(참고 문서 3건)입니다. "
    "이 문서들에는 정답과 관련된 핵심 정보뿐만 아니라 관련 없는 내용(노이즈)도 섞여 있습니다. "
    "반드시 **문맥에 맞는 정보만 선별**하여 정답을 추론하세요.\n\n"
)
NO_TITLE = "제목 없음"
NO_CHOICES = "없음"

#: Chat templates.
TEMPLATES = {
    "base": """<SYSTEM>
지문을 읽고 질문의 답을 구하세요.
</SYSTEM>

<USER>
지문:
{paragraph}

질문:
{question}

{question_plus}

선택지:
{choices}

외부문서:
{documents}

1, 2, 3, 4, 5 중에 하나를 정답으로 고르세요.
정답:
</USER>
""",
    "rag_eval": """<SYSTEM>
당신은 한국사 RAG 기반 문제 풀이 모델입니다.
- 아래 CONTEXT는 gold_doc_ids로 매칭된 근거 문서에서 발췌한 내용입니다.
- CONTEXT에 없는 정보는 추론하거나 만들어내지 말고, 근거 부족을 명시하세요.
- 답변은 객관식 정답 번호(1~5)만 출력합니다.

CONTEXT:
{context}
</SYSTEM>

<USER>
지문:
{paragraph}

질문:
{question}

{question_plus}

선택지:
{choices}

1, 2, 3, 4, 5 중에 하나를 정답으로 고르세요.
정답:
</USER>
""",
}

#: Prompts of the two gate stages and of the document chooser.
HISTORY_GATE = """
        다음 문제는 한국사 문제인가?

        판단 기준:
        - 질문이 한국의 역사적 인물·사건·단체·제도·사상의 정체나 사실을 묻으면 한국사
        - 지문에 한국사 소재가 있어도, 지문 내용만 확인하는 독해 문제면 비한국사

        문제:
        {paragraph}

        질문:
        {question}

        선택지:
        {choices}

        A = 한국사
        B = 비한국사

        출력은 A 또는 B
        출력:"""
DOCUMENT_GATE = """
        다음은 한국사 문제이다.

        당신의 임무는 paragraph 안에 정답을 선택할 수 있는 '근거 문장'이 존재하는지 여부를 판단하는 것이다.

        중요 규칙:
        - 추론 금지
        - 상식 사용 금지
        - 의미 유추 금지
        - paragraph에 없는 정보를 알고 있어야만 정답을 고를 수 있다면 외부 문서가 필요하다고 판단한다.

        판단:
        A = paragraph에 정답의 근거가 없음 (외부 문서 필요)
        B = paragraph에 정답의 근거가 있음 (외부 문서 불필요)

        paragraph:
        {paragraph}

        question:
        {question}

        choices:
        {choices}

        출력은 반드시 A 또는 B 한 글자.
        출력:"""
CHOOSER = """
질문과 정답을 보고, 아래 후보 문서 중 근거가 될 가능성이 높은 문서 id를 최대 {limit}개까지 골라 JSON 배열로만 답하세요.

질문+정답: {query}
후보:
{candidates}

출력 예시: ["doc-001"] 또는 ["doc-001","doc-002"] 혹은 확신 없으면 [] 만.
"""

#: Answers of exams whose sheets are images, by subject and year, then question number.
IMAGE_SHEETS = {
    ("국어", 2025): {
        1: "3", 2: "4", 3: "5", 4: "4", 5: "5", 6: "3", 7: "2", 8: "1", 9: "2", 10: "3",
        11: "1", 12: "5", 13: "3", 14: "1", 15: "2", 16: "2", 17: "3",
        18: "2", 19: "4", 20: "1", 21: "4", 22: "4", 23: "5", 24: "2", 25: "2",
        26: "1", 27: "1", 28: "4", 29: "3", 30: "5", 31: "4", 32: "3", 33: "5", 34: "2",
    },
    ("한국사", 2025): {
        1: "5", 2: "1", 3: "3", 4: "3", 5: "1",
        6: "4", 7: "5", 8: "2", 9: "5", 10: "3",
        11: "5", 12: "4", 13: "1", 14: "3", 15: "2",
        16: "2", 17: "4", 18: "3", 19: "2", 20: "1",
    },
}
