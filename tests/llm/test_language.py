import pytest

from threadloom.llm import language as L
from threadloom.session import read_table

HELD_OUT = {
    "en": "Nobody could tell why the train was late, so we walked home through the rain.", "es": "Nadie supo decir por qué el tren llegó tarde, así que volvimos a casa andando.",
    "fr": "Personne ne savait pourquoi le train était en retard, alors nous sommes rentrés à pied.", "de": "Niemand wusste, warum der Zug zu spät kam, deshalb gingen wir zu Fuß nach Hause.",
    "pt": "Ninguém sabia por que o trem atrasou, então voltamos para casa a pé debaixo da chuva.", "ru": "Никто не знал, почему поезд опоздал, поэтому мы пошли домой пешком.",
    "ja": "電車がなぜ遅れたのか誰も知らなかったので、雨の中を歩いて帰りました。", "zh": "没有人知道火车为什么晚点，所以我们冒着雨走回家。",
}


#: Languages the centroids don't know.
FOREIGN = {
    "it": "Nessuno sapeva dire perché il treno fosse in ritardo, quindi siamo tornati a casa a piedi sotto la pioggia. Vorrei sapere se potete aiutarci con questa richiesta prima di domani.",
    "nl": "Niemand kon zeggen waarom de trein te laat was, dus liepen we door de regen naar huis. Ik zou graag willen weten of jullie ons hiermee kunnen helpen voor morgen.",
    "pl": "Nikt nie wiedział, dlaczego pociąg się spóźnił, więc wróciliśmy do domu pieszo w deszczu. Chciałbym wiedzieć, czy możecie nam z tym pomóc przed jutrem.",
    "ro": "Nimeni nu știa de ce trenul a întârziat, așa că ne-am întors acasă pe jos prin ploaie. Aș vrea să știu dacă ne puteți ajuta cu asta până mâine.",
    "uk": "Ніхто не знав, чому потяг запізнився, тому ми пішли додому пішки під дощем. Я хотів би знати, чи можете ви нам із цим допомогти до завтра.",
    "sv": "Ingen visste varför tåget var försenat, så vi gick hem genom regnet. Jag skulle vilja veta om ni kan hjälpa oss med detta före imorgon.",
    "tr": "Trenin neden geç kaldığını kimse bilmiyordu, bu yüzden yağmurda eve yürüdük. Yarından önce bu konuda bize yardım edip edemeyeceğinizi bilmek istiyorum.",
    "cs": "Nikdo nevěděl, proč měl vlak zpoždění, a tak jsme šli domů pěšky v dešti. Rád bych věděl, zda nám s tím můžete pomoci do zítřka.",
    "fi": "Kukaan ei tiennyt, miksi juna oli myöhässä, joten kävelimme kotiin sateessa. Haluaisin tietää, voitteko auttaa meitä tässä ennen huomista.",
    "da": "Ingen vidste, hvorfor toget var forsinket, så vi gik hjem gennem regnen. Jeg vil gerne vide, om I kan hjælpe os med dette inden i morgen.",
    "hu": "Senki sem tudta, miért késett a vonat, ezért gyalog mentünk haza az esőben. Szeretném tudni, hogy tudnak-e segíteni ebben holnap előtt.",
}
#: Held-out texts of the eight languages, about things the corpus never speaks of.
KNOWN = {
    "en": "Nobody could tell why the train was late, so we walked home through the rain. I would be glad if you could help us with this request before tomorrow morning. She bought three apples and a loaf of bread at the market.",
    "es": "Nadie supo decir por qué el tren llegó tarde, así que volvimos a casa andando. Me alegraría que pudieras ayudarnos con esta petición antes de mañana. Ella compró tres manzanas y una barra de pan en el mercado.",
    "fr": "Personne ne savait pourquoi le train était en retard, alors nous sommes rentrés à pied. Je serais heureux si vous pouviez nous aider avant demain matin. Elle a acheté trois pommes et une baguette au marché.",
    "de": "Niemand wusste, warum der Zug zu spät kam, deshalb gingen wir zu Fuß nach Hause. Ich wäre froh, wenn ihr uns vor morgen früh dabei helfen könntet. Sie kaufte drei Äpfel und ein Brot auf dem Markt.",
    "pt": "Ninguém sabia por que o trem atrasou, então voltamos para casa a pé debaixo da chuva. Eu ficaria feliz se você pudesse nos ajudar antes de amanhã cedo. Ela comprou três maçãs e um pão no mercado.",
    "ru": "Никто не знал, почему поезд опоздал, поэтому мы пошли домой пешком. Я был бы рад, если бы вы помогли нам до завтрашнего утра. Она купила три яблока и буханку хлеба на рынке.",
    "ja": "電車がなぜ遅れたのか誰も知らなかったので、雨の中を歩いて帰りました。明日の朝までに手伝っていただけると嬉しいです。彼女は市場でりんごを三つ買いました。",
    "zh": "没有人知道火车为什么晚点，所以我们冒着雨走回家。如果你能在明天早上之前帮助我们，我会很高兴。她在市场买了三个苹果和一条面包。",
}


@pytest.fixture(scope="module")
def wide(spark):
    return L.fit(read_table(spark, "/root/testdata/sf0.01", "documents"))


def test_other_languages_are_rejected_and_the_eight_are_kept(wide):
    assert {k: [x[0] for x in L.segments(t, wide)] for k, t in KNOWN.items()} == {k: [k] for k in KNOWN}
    kept = {k: held for k, t in FOREIGN.items() if (held := [x[0] for x in L.segments(t, wide) if x[0]])}
    assert not kept


@pytest.fixture(scope="module")
def model(spark, data):
    return L.fit(read_table(spark, data, "documents"))


def test_labels():
    assert [L.stated_language(x) for x in ("en", "EN", "en_GB", "English", " deu ", "zh-Hans-CN", "pt-BR", "por", "xx", "und", "", None, "n/a")] == ["en", "en", "en", "en", "de", "zh", "pt", "pt", "", "", "", "", ""]


def test_held_out_sentences(model):
    for lang, text in HELD_OUT.items():
        (got, conf, letters, _), = L.segments(text, model)
        assert got == lang and 0 < conf <= 1 and letters > 20
    assert L.segments(L._plain(HELD_OUT["es"]), model)[0][0] == "es" and L.segments(L._plain(HELD_OUT["pt"]), model)[0][0] == "pt"


def test_held_out_documents(spark, model):
    """Documents of another size whose label agrees with their script or function words: nearly all are told right."""
    docs = read_table(spark, "/root/testdata/sf0.01", "documents").where("length(text) between 80 and 2000").collect()
    right = n = 0
    for d in docs:
        lang = L.stated_language(d.lang)
        held = {k for k, _, m, _ in L.segments(d.text, model) if k and m >= 20}
        if lang and held:
            n += 1
            right += lang in held
    assert n > 500 and right / n > 0.9  # the rest are wrong labels


def test_mixed_code_and_garbled(model):
    text = f"{HELD_OUT['en']} {HELD_OUT['de']}\n```\nSELECT a FROM b;\n```\n{HELD_OUT['ja']}\n10:02:03 GET /api/x?page=1 200\nconst a = b(1);"
    assert [x[0] for x in L.segments(text, model)] == ["en", "de", "ja"]
    assert L.segments(HELD_OUT["pt"].encode().decode("latin-1"), model)[0][0] == "pt"
    assert L.segments("終わったら leontine dot ostova at example dot org までご連絡ください。", model)[0][0] == "ja"
    assert len(L.segments("終わったら leontine dot ostova at example dot org までご連絡ください。", model)) == 1
    for t in (None, "", "  ", "ok", "src/a/b.py", "👍"):
        assert not [x for x in L.segments(t, model) if x[2] >= 20]


def test_quotes_and_headings_are_prose_and_prompts_are_not(model):
    for mark in ("> ", "# ", "  > "):
        for lang in ("fr", "pt", "ja"):
            assert [x[0] for x in L.segments(f"{HELD_OUT['en']}\n{mark}{HELD_OUT[lang]}", model)] == ["en", lang]
    commands = ["> npm run build", "# apt-get install -y libpq-dev", "> vitest", "> app@1.2.0 test", "# cd /srv/app", "> python -m pytest tests", "> git push origin main", "> const a = b(1);", "$ make all"]
    assert not list(L.prose_sentences("\n".join(commands)))
    prose = ["> find out why the index is stale", "# make it work", "> git is broken since yesterday", "> find the bug in that index.ts file"]
    assert [s.split()[0] for s in L.prose_sentences("\n".join(prose))] == ["find", "make", "git", "find"]


def test_batches_agree_with_single_items(model):
    texts = [*HELD_OUT.values(), None, "", "ok"] * 80
    one = [L.joined_segments(next(L.classified_all([t], ["en"], model))) for t in texts]
    assert list(map(L.joined_segments, L.classified_all(texts, ["en"] * len(texts), model))) == one


def test_items(spark, model, make_records):
    from tests.conftest import record

    docs = spark.createDataFrame([(1, HELD_OUT["fr"], "en"), (2, HELD_OUT["fr"], "fr-FR"), (3, None, "en"), (4, HELD_OUT["fr"] + " " + HELD_OUT["ru"], "French")], "doc_id long, text string, lang string")
    recs = make_records([record(7, text=HELD_OUT["es"], lang="n/a"), record(8, text="Yes.", lang="en"), record(8, text=HELD_OUT["es"], lang="es")])
    got = sorted(map(tuple, L.unstated(L.held_languages(L.items_of(docs, recs), model)).collect()))
    assert got == [("documents", 1, "fr"), ("documents", 4, "ru"), ("records", 7, "es")]
    assert L.held_languages(L.items_of(docs.limit(0), recs.limit(0)), model).count() == 0
