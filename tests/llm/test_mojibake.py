import pytest

from threadloom.llm import mojibake

CLEAN = [
    "Don’t refactor the upload yet — the owner is “still” deciding… ok", "Für morgen müssten wir noch den Knopf für Rückmeldungen prüfen", "La función de búsqueda quedó vacía y nadie se dio cuenta",
    "Il faut réécrire le formulaire de défaut, déjà prêt à côté", "Não é preciso mudar a migração de revisão, então vou ver", "Сначала нужно проверить историю ошибок, а потом изменить кнопку",
    "Κανείς δεν ήξερε γιατί άργησε το τρένο, οπότε γυρίσαμε σπίτι με τα πόδια.", "איש לא ידע מדוע הרכבת איחרה, ולכן חזרנו הביתה ברגל.", "لم يعرف أحد لماذا تأخر القطار، فعدنا إلى البيت سيرا على الأقدام.",
    "ไม่มีใครรู้ว่าทำไมรถไฟถึงมาสาย เราจึงเดินกลับบ้าน", "기차가 왜 늦었는지 아무도 몰랐기 때문에 우리는 걸어서 집에 돌아왔습니다.", "किसी को नहीं पता था कि ट्रेन देर से क्यों आई।", "Ніхто не знав, чому потяг запізнився, тому ми пішли додому пішки.",
    "これから設定の報告書を公開して、結果をお見せします。", "请先发布语言流程，然后再修改发布表格，最后告诉我结果。",
]
DECOYS = [
    "┌─┬─┐\n│ 1│ 2│\n└─┴─┘", "ATENÇÃO: NÃO É PARA MEXER", "Ð ð Þ þ Ñ Ø å", "™ © § 20 °C ± 3 € £", "«Âge» · ¿Ó? · €5 £3 ¥2", "ﬁnal ½ ①", "👩🏽‍💻🚀 🇳🇴🇯🇵", "café naïve", "AÇÃO À MÃO, NÃO Â", "‮abc‬", None, "", "  ",
]


@pytest.mark.parametrize("text", CLEAN + DECOYS)
def test_clean_texts_stay(text):
    assert mojibake.repair(text) == (text, False)


@pytest.mark.parametrize("text", CLEAN)
@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "mac_roman", "double"])
def test_utf8_read_wrongly_comes_back(text, wrong):
    def garble(x, code):
        return mojibake._decode(x.encode(), code)

    bad = garble(garble(text, "cp1252"), "cp1252") if wrong == "double" else garble(text, wrong)
    whole = f"Plain line.\n{bad}\nAnother plain line."
    back, garbled = mojibake.repair(whole)
    assert garbled and back == f"Plain line.\n{text}\nAnother plain line."


@pytest.mark.parametrize("text", CLEAN)
@pytest.mark.parametrize("rounds", [3, 5])
def test_many_rounds_come_back(text, rounds):
    bad = text
    for _ in range(rounds):
        bad = bad.encode().decode("latin-1")
    assert mojibake.repair(bad) == (text, True)


def test_the_caller_may_bound_the_search():
    bad = CLEAN[1].encode().decode("latin-1").encode().decode("latin-1").encode().decode("latin-1")
    assert mojibake.search(bad, max_expanded=1)[0] != CLEAN[1] and mojibake.search(bad)[0] == CLEAN[1]


def test_lost_characters_in_other_codes():
    assert mojibake.repair("the ï¿½ fix")[1] and mojibake.repair("the пїЅ fix")[1]


@pytest.mark.parametrize("code, wrong", [("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "koi8_r"), ("cp1251", "latin-1")])
def test_cyrillic_codes(code, wrong):
    text = CLEAN[5]
    back, garbled = mojibake.repair(mojibake._decode(text.encode(code), wrong))
    assert garbled and back == text


def test_parts_and_lost_characters():
    assert mojibake.repair("It’s the â€œquick” fix") == ("It’s the “quick” fix", True)
    assert mojibake.repair("ainda não publicaÃ§ão") == ("ainda não publicação", True)
    assert mojibake.repair("失敗していますã€‚") == ("失敗しています。", True)
    assert mojibake.repair("the ���quick��� fix")[1]


def test_table(spark):
    rows = [(1, None, "x"), (2, "MenÃ¼", "x"), (3, "Menü", "x"), (4, "MenÃ¼ " * 9000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, garbled string")
    got = {r.doc_id: (r.garbled, r.restored) for r in mojibake.restore(df).collect()}
    assert got == {1: (False, None), 2: (True, "Menü"), 3: (False, "Menü"), 4: (True, "Menü " * 9000)}
    assert mojibake.restore(df.limit(0)).count() == 0
