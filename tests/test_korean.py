"""Spelling and spacing rules against fixed cases and properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import korean as K

KEEP = """확인해 주세요|총 66 명이 참석|Route 66 Highway|1999 년 설립|수량99|저장되었습니다|이용자관리화면|무등산|거대해서|변수없이|말이 통한다고|공부하는구나
목표를 달성하기 위해서는 노력해야 한다.|경영자는 중요한 역할을 한다.|마이클 포터(Michael Porter)의 지적(知的) 기여|경영자들에게 필요한 것|우리나라에서 사람들에게는
그의 말을 들은 뒤 참고할 자료|Z이론의 핵심|머지않아 마지못해 못지않은|3가지를 꼽는다. 500이라는 숫자|GE에서는 GM에게만 A은행에|조직이 비대해지면 실수없이 별수없이
나는 안 가. 기로에 서 있다|요시하루와 T. 의 관계|전해 들은 이야기. 할 때 이미 늦었다|잘 대해주지만 마이크로프로세서에만 스탠퍼드대학교로부터|그렇게 됐다|하지 않했다
아이디를 입력한다|하이디와 친구|잔디를 깎았다|미연방항소법원은|날것이 좋다|아무것도 없다|무언가 있는 것같이 보였다|보잘것도 없다|좋디좋은 날|질서가잡힌 사회""".replace("\n", "|").split("|")
FIX = {
    "66안녕하세요.99": '"안녕하세요."', "할수있다": "할 수 있다", "이를위해": "이를 위해", "그로인해": "그로 인해", "먹을것이다": "먹을 것이다", "않되는": "안 되는",
    "위로하는그림하루를다독이는명언": "위로하는 그림 하루를 다독이는 명언", "보여서는 안 돼었다.": "보여서는 안 되었다.", "희안한 일": "희한한 일", "숙제를 않했다": "숙제를 안 했다",
    "그것은 사실이디.": "그것은 사실이다.", "할 수 있었디": "할 수 있었다", "하고 있디-. 그러나": "하고 있다. 그러나", "많지 않 았다": "많지 않았다",
    "하지 않 는다. 하지 않 는다. 하지 않 는다.": "하지 않는다. 하지 않는다. 하지 않는다.", "영힝올 받았다": "영향을 받았다", "그것 때문어다": "그것 때문이다",
    "누군가 본것같다": "누군가 본 것 같다", "일을 할때는 집중한다": "일을 할 때는 집중한다", "그런줄알았다": "그런 줄 알았다", "청년충의 생각": "청년층의 생각", "번 역 : 가": "번역 : 가",
}


@pytest.fixture(scope="module")
def refined(spark):
    rows = [(x,) for x in [*KEEP, *FIX, None, ""]]
    return {r.x: r.y for r in spark.createDataFrame(rows, "x string").select("x", K.refined(F.col("x")).alias("y")).collect()}


def test_right_texts_stay(refined):
    assert {x: refined[x] for x in KEEP} == {x: x for x in KEEP}


def test_wrong_texts_are_repaired(refined):
    assert {x: refined[x] for x in FIX} == FIX


def test_null_and_empty(refined):
    assert refined[None] == refined[""] == ""


def test_pairs_the_text_writes_as_one():
    assert K.rejoin("나무꾼 나무꾼 나무 꾼") == "나무꾼 나무꾼 나무꾼"
    assert K.rejoin("나무꾼 나무꾼 나무 꾼 나무 꾼 나무 꾼") == "나무꾼 나무꾼 나무 꾼 나무 꾼 나무 꾼"
    assert K.rejoin("이점 이점 이 점 점 점") == "이점 이점 이 점 점 점"


def test_run_of_words():
    assert K.segment("이책은초보세일즈맨을위한매뉴얼이다").replace(" ", "") == "이책은초보세일즈맨을위한매뉴얼이다"
    assert K.segment("이책은초보세일즈맨을위한매뉴얼이다").startswith("이 책은")


@settings(max_examples=200, deadline=None)
@given(st.text("이책은세일즈맨을위한에서으로부터가나다", min_size=0, max_size=60))
def test_segmenting_only_adds_spaces(word):
    out = K.segment(word)
    assert out.replace(" ", "") == word and "  " not in out
