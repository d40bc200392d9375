"""Text functions on short texts whose results are known."""

import hashlib
import html
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from askloom import answer_sql as S
from askloom import queries
from askloom.functions import answers as A
from askloom.functions import patterns as P
from askloom.functions import text as T


@pytest.fixture(scope="module")
def one(spark):
    def value(make, *texts):
        names = [f"c{i}" for i in range(len(texts))]
        schema = ", ".join(f"{n} string" for n in names)
        df = spark.createDataFrame([tuple(texts)], schema)
        return df.select(make(*[F.col(n) for n in names]).alias("x")).first()["x"]

    return value


@pytest.mark.parametrize(
    ("make", "text", "want"),
    [
        (T.normalize_for_embedding, "счёт", "счет"),
        (T.normalize_for_embedding, "СЧЁТ  x ", "СЧЕТ x"),
        (T.normalize_for_embedding, "café", "café"),
        (T.normalize_for_embedding, None, ""),
        (T.strip_chunk_id, " [17] Текст", "Текст"),
        (T.strip_html, "<b>Счёт</b>", " Счёт "),
        (T.strip_html, "a&nbsp;b &zzzz; c", "a\xa0b   c"),
        (T.normalize_whitespace, "a\xa0\xa0b\t\tc\n\n\n\nd", "a b c\n\nd"),
        (T.remove_decorative, "A\n***\nB||C____D", "A\n\nBCD"),
        (T.trim_incomplete, "Дверь открыта. Потом надо", "Дверь открыта."),
        (T.trim_incomplete, "Полное предложение.  ", "Полное предложение."),
        (T.trim_incomplete, "без конца", "без конца"),
        (T.trim_incomplete, "", ""),
        (T.clean_chunk, "[7] <i>Вклад</i>&nbsp;открывают в отделении. Ещё", "Вклад открывают в отделении."),
        (T.clean_chunk, "коротко", ""),
        (T.clean_chunk, None, ""),
        (T.clean_chunk, "Контекст для ответа на вопрос: Вклад открывают в отделении.", "Вклад открывают в отделении."),
        (T.clean_text, "<p>Вклад&nbsp;открыт.</p> Обратите внимание: сроки.", "Вклад открыт. сроки."),
        (T.clean_text, "Свяжитесь с нами по телефону. Дальше.", "Дальше."),
        (T.clean_text, "<!-- x --> a", "a"),
        (T.normalize_text, "Ёлка И ЁЖ", "елка и еж"),
        (T.tokenize, "Счёт-фактура №5, а_b x yz!", ["счёт", "фактура", "а_b", "yz"]),
        (T.split_sentences, "Первое дело. Второе дело! Третье?", ["Первое дело.", "Второе дело!", "Третье?"]),
        (T.split_sentences, "Живёт на ул. Мира, д. 5. А. С. Пушкин писал.", ["Живёт на ул. Мира, д. 5.", "А. С. Пушкин писал."]),
        (T.split_sentences, "   \n\t ", []),
        (T.split_sentences, None, []),
        (T.split_sentences, "Одно предложение.", ["Одно предложение."]),
        (T.split_long_sentences, "Да. Это длиннее.", ["Это длиннее."]),
        (T.clean_context_sentence, "Контекст для ответа на вопрос: Так. PASSWORDDD --- Контекст и далее", "Так."),
        (T.is_prompt_metadata, " Вопрос: как", True),
        (T.is_prompt_metadata, "Как", False),
        (T.is_junk_sentence, "Узнайте больше о картах", True),
        (T.is_junk_sentence, "1, 2, 3,", True),
        (T.is_junk_sentence, "Карту выдают за день.", False),
        (T.drop_bracket_prefix, "[12] текст", "текст"),
        (T.drop_bracket_prefix, "текст ] x", "текст ] x"),
        (lambda c: T.truncate_words(c, 4), "один два. три четыре пять", "один два. три четыре"),
        (lambda c: T.truncate_words(c, 4), "один два три. четыре пять", "один два три."),
        (lambda c: T.truncate_words(c, 9), "как есть  тут", "как есть  тут"),
        (lambda c: T.truncate_chars(c, 10), "Абв где. Жзи клм", "Абв где."),
        (lambda c: T.truncate_chars(c, 10), "абвгдежз иклмн", "абвгдежз"),
        (lambda c: T.truncate_chars(c, 5), "абвгдежз", "абвгд"),
        (lambda c: T.truncate_chars(c, 20), "Раз! Два. Три? Четыре пять", "Раз! Два."),
        (lambda c: T.truncate_sentences(c, 2), "Раз тут. Два там. Три.", "Раз тут. Два там."),
        (lambda c: T.cap_context(c, 20, 5), "Первая часть. Вторая часть тут.", "Первая часть."),
    ],
)
def test_text(one, make, text, want):
    assert one(make, text) == want


def test_hash_is_blind_to_yo_and_case(one):
    want = hashlib.sha256("счет открыт".encode()).hexdigest()[:32]
    assert one(T.chunk_hash, "Счёт  открыт ") == one(T.chunk_hash, "СЧЕТ ОТКРЫТ") == want


@pytest.mark.parametrize(
    ("word", "text", "want"),
    [("карты", "номер карта", True), ("счетов", "мой счет", True), ("вклад", "вклады", True), ("банк", "сад", False), ("дом", "сад", True)],
)
def test_word_matches(one, word, text, want):
    assert one(T.word_matches, word, text) is want


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ("мало", True),
        (None, True),
        ("Карту можно получить в отделении банка за один день.", False),
        ("Номер somethingётного вклада виден в приложении", True),
        ("Вопрос: как получить карту? Контекст: отделение", True),
        ("Нет ответа на такой вопрос клиента", True),
        ("- " * 40, True),
        ("_xyzxyzxyzxyzxyzxyzxyzxyzxyzxyzxyz", True),
        ("Можно ли закрыть вклад до срока? Для этого подают заявление в банк лично.", True),
        ("Есть несколько способов проверить, зачислены ли", True),
        ("Введите SMS и PIN в приложении, чтобы подтвердить вход.", False),
        ("Введите wonderland в приложении, чтобы подтвердить вход.", True),
        ("Откройте https://example.org/wonderland и войдите в кабинет.", False),
        ("1, 2, 3, 4, 5, 6,", True),
        ("слово " * 30, True),
        ("12345678901234567890 ок", True),
        ("Текст с 漢字 посередине фразы", True),
        ("Где карта? Где моя карта?", True),
        ("К PASSWORDPASSWORD требования банка", True),
    ],
)
def test_garbage(one, answer, want):
    assert one(A.is_garbage, answer) is want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Согласно Фрагменту 3, карты выдают сразу.", "карты выдают сразу."),
        ("В Фрагмент 8: история показывает платежи.", "история показывает платежи."),
        ("Карты выдают сразу. Ответ: Да.", "Карты выдают сразу. Да."),
        ("Если код не дошёл, банк шлёт SMS. Также, в Фрагменте 2 указан номер. Ответ: Звоните.", "Если код не дошёл, банк шлёт SMS. Звоните."),
        (None, ""),
        ("а , б ;. в", "а, б. в"),
    ],
)
def test_clean_reference(one, text, want):
    assert one(A.clean_reference, text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("«Согласно контексту, таким образом, карта готова. (Фрагмент 2)", "карта готова."),
        (" - Ответ: да, готова", "да, готова"),
        ("Карта готова.", "Карта готова."),
    ],
)
def test_strip_preamble(one, text, want):
    assert one(A.strip_preamble, text) == want


@pytest.mark.parametrize(
    "text",
    ["«Ответ: Ответ: x", "--в фрагментах 2 указано, таким образом: y", ": \n Ответ: z", "исходя из контекста ответ: — w (фрагмент 3).", "нет", "  «\"—-: "],
)
def test_strip_preamble_is_a_fixpoint(one, text):
    from askloom.functions import patterns as P

    core = re.compile(P.PREAMBLE, re.I)
    want, last = text, None
    while want != last:
        last = want
        want = core.sub("", want).lstrip(' «"—-:')
    want = re.sub(P.TRAILING_FRAGMENT, "", want, flags=re.I).strip()
    assert one(A.strip_preamble, text) == want


def test_clean_answer(one):
    text = "Ответ: карта карта готова [Фрагмент 4] на основе контекста.\nВопрос: ещё"
    assert one(A.clean_answer, text) == "карта готова"


def test_validate(one):
    valid = lambda n: lambda q, a: A.validate_answer(q, a, n)
    assert one(valid(0), "вопрос", "любой") is True
    assert one(valid(0), "вопрос", "  ") is False
    assert one(valid(1), "как получить карту?", "карту получают в банке") is True
    assert one(valid(2), "как получить карту?", "карту дают в банке") is False
    assert one(valid(1), "как", "что угодно") is True


def test_prompts_and_keys(one):
    assert one(A.label_prompt, "q", "") == "q"
    assert one(A.label_prompt, "q", "c") == "Контекст:\nc\n\nВопрос: q"
    assert one(A.augment_context, "ctx", None) == "ctx"
    assert one(A.augment_context, "ctx", "Да, можно.") == "Да, можно.\n\n---\n\nctx"
    raw = "v7-parent-child-rag|q|m"
    assert one(lambda q: A.cache_key(q, "m"), " q ") == hashlib.sha256(raw.encode()).hexdigest()[:16]
    assert one(A.first_piece, " . Первый кусок! второй", "q") == "Первый кусок"
    assert one(A.first_piece, "", "q") == "q"


def test_unescape_matches_the_library(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("html", T.html_unescape("html").alias("x")).collect()
    assert all(r.x == html.unescape(r.html) for r in pages)


@pytest.mark.parametrize("name", ["service_phrases", "answer_cleaning", "reference_cleaning", "garbage_rules", "word_endings", "sentence_rules"])
def test_rules_agree_with_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    found = queries.QUERIES[name](spark, sf_dir)
    want = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert sorted(want.columns) == columns
    rows = want.select(*columns).fetchall()
    assert sorted(map(str, (tuple(r) for r in found.select(columns).collect()))) == sorted(map(str, rows))


#: Texts with their sentences, as a reader would set them apart.
SENTENCES = [
    ("Живёт на ул. Мира, д. 5. А. С. Пушкин писал.", ["Живёт на ул. Мира, д. 5.", "А. С. Пушкин писал."]),
    ("Купил хлеб, молоко и т. д. Потом ушёл.", ["Купил хлеб, молоко и т. д.", "Потом ушёл."]),
    ("Это было в 2005 г. Москва росла.", ["Это было в 2005 г. Москва росла."]),
    ("Цена 5 тыс. 300 руб. Скидки нет.", ["Цена 5 тыс. 300 руб.", "Скидки нет."]),
    ("Он сказал (это важно. Очень важно!) и ушёл. Все.", ["Он сказал (это важно. Очень важно!) и ушёл.", "Все."]),
    ("«Да. Конечно!» — сказал он. Потом сел.", ["«Да. Конечно!» — сказал он.", "Потом сел."]),
    ("«Приду завтра.» Он ушёл.", ["«Приду завтра.»", "Он ушёл."]),
    ("1. Откройте счёт. 2. Внесите деньги.", ["1. Откройте счёт.", "2. Внесите деньги."]),
    ("См. рис. 5. Далее текст.", ["См. рис. 5.", "Далее текст."]),
    ("Mr. Smith met Dr. Brown. They talked, e.g. about J. R. R. Tolkien.", ["Mr. Smith met Dr. Brown.", "They talked, e.g. about J. R. R. Tolkien."]),
    ('He said "Wait. Stop!" and left. Then silence.', ['He said "Wait. Stop!" and left.', 'Then silence.']),
    ("Сколько? Пять... Нет, шесть!", ["Сколько?", "Пять...", "Нет, шесть!"]),
    ("Первое; второе; Третье.", ["Первое; второе;", "Третье."]),
    ("в 300 г. до н. э. Рим рос.", ["в 300 г. до н. э.", "Рим рос."]),
    ("IV. Итоги года. Конец", ["IV. Итоги года.", "Конец"]),
    ("Точка.Без пробела. Да", ["Точка.Без пробела.", "Да"]),
    ("Открыта скобка (вот так. Дальше без конца. И ещё.", ["Открыта скобка (вот так.", "Дальше без конца.", "И ещё."]),
    ("Абзац.\n\nНовый абзац", ["Абзац.", "Новый абзац"]),
    ("Работает с 9 a.m. Monday. Ends 5 p.m. 30 sharp", ["Работает с 9 a.m.", "Monday.", "Ends 5 p.m. 30 sharp"]),
    ("", []),(None, []),("  \n\t ", []),("!", ["!"]),
]


def test_sentences_as_a_reader_sets_them(spark):
    rows = [(i, text) for i, (text, _) in enumerate(SENTENCES)]
    df = spark.createDataFrame(rows, "i int, text string").select("i", T.split_sentences("text").alias("s"))
    got = {r.i: r.s for r in df.collect()}
    for i, (text, want) in enumerate(SENTENCES):
        assert got[i] == want, text


def test_sentences_by_sql_written_apart(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE t(i INT, x VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(i, text) for i, (text, _) in enumerate(SENTENCES)])
    assert dict(con.sql(f"SELECT i, {S.sentences('x')} FROM t").fetchall()) == {i: want for i, (_, want) in enumerate(SENTENCES)}


def test_a_long_text_without_an_end(spark):
    texts = ["слово " * 300_000, "(" * 20_000 + ". A" * 20_000, "A. " * 50_000, "Да! " * 100_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(F.size(T.split_sentences("text")).alias("n"))
    assert [r.n for r in df.collect()] == [1, 2, 1, 100_000]


def test_rows_that_nothing_changes_stay_in_arrow():
    import pyarrow as pa

    texts = pa.array(["a", None, "&lt;b", "", "c &amp; d"] * 300)
    some = pa.array([False, None, True, False, True] * 300)
    assert T._changed(texts, pa.array([False] * len(texts)), None) is texts
    seen = []
    made = T._changed(texts, some, lambda t: seen.append(t) or t.upper())
    assert made.to_pylist() == ["a", None, "&LT;B", "", "C &AMP; D"] * 300 and len(seen) == 600


def test_rules_around_a_place_are_tried_where_they_can_apply(spark):
    """Rules that look far around a candidate are chosen by the text, so most texts aren't looked through for them."""
    cases = {
        "One (two. Three) four. Five.": ["One (two. Three) four.", "Five."],
        "One (two. Three four. Five.": ["One (two.", "Three four.", "Five."],
        "One «two. Three» four. Five.": ["One «two. Three» four.", "Five."],
        "One “two. Three” four. Five.": ["One “two. Three” four.", "Five."],
        'One "two. Three" four. Five.': ['One "two. Three" four.', "Five."],
        "One two. Three four.": ["One two.", "Three four."],
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want array<string>").withColumn("got", T.split_sentences("t"))
    assert [tuple(r) for r in df.where("got <> want").collect()] == []
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?!)") >= 4


def test_a_text_is_made_once_for_all_that_looks_at_it(spark):
    df = spark.createDataFrame([("Номер виден в договоре.", "Где номер?")], "answer string, query string")
    times = lambda c, what: df.select(c.alias("x"))._jdf.queryExecution().analyzed().toString().count(what)
    assert times(A.postprocess_answer(F.col("answer")), P.REFERENCE_END) == 1
    # links are taken out once, and the text itself is cleaned once before it is judged
    assert times(A.is_garbage(A.clean_answer(F.col("answer"))), r"https?://\S+") == 1
    assert times(A.is_garbage(A.clean_answer(F.col("answer"))), P.REFERENCE_END) == 1
    assert times(T.truncate_chars(T.truncate_sentences(A.clean_answer(F.col("answer")), 5), 550), P.REFERENCE_END) == 1
