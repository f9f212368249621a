import pytest

from brightloom.llm import stuffing

PROSE = "Last spring, the records in Keskoport go back to 2020, as the course assistant wrote in 2009. During the second pass, a pricing team tried to simplify survey design with a prior, and that changed how people there think about credit. Nobody had asked whether rents can be read from tender books. "
PROSE_ES = "Más tarde, el método anterior tardaba doce semanas más, al menos fuera de la ciudad. Un grupo de seminario cuenta con solo siete observaciones cuando una estudiante agrega los registros de viajes. Según la oficina, nadie pensaba en los contratos. "
SPAM = {
    "keywords": "cheap panel data, best panel data, buy ad bidding, panel data near me, top ad bidding, panel data review, free ad bidding, " * 6,
    "links": "\n".join(f"https://wiki.place{i}.example/papers/topic-{i}" for i in range(30)),
    "link texts": " ".join(f"[best ad bidding {i}](https://a{i}.example/x)" for i in range(30)),
    "tags": " ".join(f"#cheap_topic_{i}" for i in range(40)),
    "labels": "\n".join(f"best panel data | SKU {i}99 | 12,{i} EUR | in stock" for i in range(20)),
    "imitation": "Panel data for the ad bidding when you need panel data with our ad bidding because panel data for the ad bidding about panel data. " * 8,
    "spanish list": "los salarios (7)\nla demanda curso\nlos salarios oferta\nel crédito [4]\nlos salarios gratis\nla demanda precio\n" * 6,
    "distinct nouns": "lamp chair table window carpet mirror shelf drawer curtain pillow blanket kettle toaster spoon ladle colander whisk grater peeler skillet saucepan",
}
GOOD = {
    "prose": PROSE * 3,
    "spanish": PROSE_ES + "Una comparación de frontera esconde el papel del tranvía, y el ayuntamiento lo toma como aviso, porque nadie había contado los vagones desde que cerró la fábrica.",
    "prose with a list at the end": PROSE * 4 + "\n\nSee also:\nhttps://a.example/b\nhttps://c.example/d\n#one #two",
    "figures": "\n".join(f"Place{i} {i}.5 {i * 3}.2 {i * 7}.1 {i}.9" for i in range(40)),
    "code": "\n".join(f"out = plot(tab, by='week', reps={i})" for i in range(40)),
    "one term": "The survey asks about rents. A survey of this kind is rare, and the survey team knows why: it takes weeks until each survey is back from the field, checked by hand and typed into the books.",
    "short": "Hi",
}

LANGUAGES = {
    "russian": "В прошлом году мы впервые посчитали, сколько людей пользуется новой линией трамвая. Оказалось, что утром вагоны почти пусты, а вечером в них трудно войти. Никто не ожидал такой разницы, и поэтому расписание решили изменить только осенью, когда вернутся студенты.",
    "polish": "W zeszłym roku po raz pierwszy policzyliśmy, ile osób korzysta z nowej linii tramwajowej. Okazało się, że rano wagony są prawie puste, a wieczorem trudno do nich wejść. Nikt nie spodziewał się takiej różnicy, dlatego rozkład zmieniono dopiero jesienią.",
    "swedish": "Förra året räknade vi för första gången hur många som åker med den nya linjen. Det visade sig att vagnarna är nästan tomma på morgonen, medan det är svårt att komma in på kvällen. Ingen hade väntat sig en sådan skillnad, och därför ändrades tidtabellen först på hösten.",
    "turkish": "Geçen yıl yeni tramvay hattını kaç kişinin kullandığını ilk kez saydık. Sabahları vagonların neredeyse boş olduğu, akşamları ise binmenin zor olduğu ortaya çıktı. Kimse böyle bir fark beklemiyordu, bu yüzden tarife ancak öğrenciler döndükten sonra değiştirildi.",
    "portuguese": "No ano passado contámos pela primeira vez quantas pessoas usam a nova linha. Verificou-se que de manhã as carruagens vão quase vazias, enquanto à noite é difícil entrar. Ninguém esperava tal diferença, e por isso o horário só mudou no outono, quando os estudantes voltaram.",
    "japanese": "昨年、私たちは新しい路線を何人が利用しているかを初めて数えた。朝の車両はほとんど空いているが、夕方は乗るのも難しいことが分かった。誰もそのような差を予想していなかったので、時刻表は秋になってから、学生が戻った後に変更された。駅の職員もこの結果に驚き、来年も同じ調査を続けると話している。",
}


@pytest.mark.parametrize("name", LANGUAGES)
def test_prose_of_other_languages_is_left_and_their_spam_found(name):
    assert stuffing.stuffing_share([PROSE, LANGUAGES[name]])[0][1] <= 0.5
    words = [w for w in stuffing.regex.findall(r"\p{L}+", LANGUAGES[name]) if len(w) > 4][:3]
    spam = ", ".join(f"{words[i % 3]} {words[(i + i // 3) % 3]}" for i in range(60))
    assert stuffing.stuffing_share([spam])[0][0] > 0.5


def test_one_long_line_with_two_signs_is_no_code():
    labels = " ".join(f"shoes{chr(97 + i % 26)} boots{chr(97 + i % 7)} sandals" for i in range(400))
    assert stuffing.stuffing_share([labels + " shoes(men) size=xl"])[0][0] > 0.5
    assert stuffing.stuffing_share([" ".join("color=red size=m brand=orwyck" for _ in range(40))])[0][0] > 0.5


@pytest.mark.parametrize("name", SPAM)
def test_stuffing_is_found(name):
    assert stuffing.stuffing_share([PROSE, SPAM[name], PROSE])[0][1] > 0.5


@pytest.mark.parametrize("name", GOOD)
def test_good_texts_are_left(name):
    assert stuffing.stuffing_share([SPAM["keywords"], GOOD[name], SPAM["links"]])[0][1] <= 0.5


def test_a_text_is_judged_by_itself():
    alone = [stuffing.stuffing_share([t])[0][0] for t in (*SPAM.values(), *GOOD.values())]
    assert list(stuffing.stuffing_share([*SPAM.values(), *GOOD.values()])[0]) == pytest.approx(alone)


def test_the_greater_part_counts():
    assert stuffing.stuffing_share([PROSE * 2 + SPAM["keywords"] * 2])[0][0] > 0.5
    assert stuffing.stuffing_share([PROSE * 9 + SPAM["keywords"][:300]])[0][0] < 0.5


def test_nulls_blanks_long_and_extra_columns(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "!!!"), (5, SPAM["keywords"] * 200), (6, PROSE * 300), (7, SPAM["links"]), (7, SPAM["links"]), (None, SPAM["links"])]
    df = spark.createDataFrame([(i, t, 0.9, 1) for i, t in rows], "doc_id bigint, text string, stuffing double, id int")
    assert {r.id for r in stuffing.flag_stuffed(df).collect()} == {5, 7}
    assert stuffing.flag_stuffed(df.limit(0)).count() == 0
