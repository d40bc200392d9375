"""DuckDB SQL of the rules on texts and answers, and the rows in Russian that they are tried on.

DuckDB's patterns have no back references, look-arounds or Unicode classes, so
repeats go through lists and words, and the rest is spelled out.
"""

from __future__ import annotations

import re

from .functions import patterns as P
from .functions import text as T

#: (id, query, text): what the rules of the language act on, which the tables don't hold.
ROWS = [
    (1, "Как узнать номер счёта?", "Согласно фрагменту 2, номер счёта виден в приложении. (Фрагмент 3)"),
    (2, "Как закрыть вклад?", "Таким образом, вклад можно закрыть в отделении.\n---\nКонтекст для ответа на вопрос:\nВклад закрывают сами."),
    (3, "Где банкомат?", "Нет ответа. Контекст: банкомат есть в каждом отделении."),
    (4, "Какая ставка?", "12, 13, 14, 15"),
    (5, "Какая ставка по вкладу?", "Ставка ставка по вкладу вкладу вкладу 12 процентов годовых."),
    (6, "Как сменить код карты?", "PASSWORDPASSWORD Смените код карты в банкомате. Нажмите и выберите раздел."),
    (7, "Где данные карты?", "данныеданныеданные карты видны в договоре банка"),
    (8, "Где работает карта?", "Картаcard работает во всех банкоматах страны."),
    (9, "Как закрыть счёт?", "Как закрыть счёт? Закрыть счёт как?"),
    (10, "Как получить карту?", "карта, " * 12 + "выдаётся в отделении банка после заявки и проверки всех данных клиента."),
    (11, "Куда звонить?", "8 800 100 20 30, 8 900 200 30 40 тел"),
    (12, "Готово?", "Да."),
    (13, "Что это?", "Тут абабабабабабабабабаб и больше ничего."),
    (14, "Как оплатить?", "Оплатите через GooglePay или Visa в отделении банка."),
    (15, "Как оплатить?", "Оплатите через overdraft в отделении банка."),
    (16, "Где ответ?", "=== Эталонный ответ (образец) ===\nОтвет есть в договоре банка.\n=== Конец эталонного ответа ==="),
    (17, "Как быть?", "Вопрос: как быть\nЗайдите в приложение, откройте раздел и выберите карту."),
    (18, "Готова ли карта?", "Ответ: карта готова. Также, в фрагменте 4 сказано обратное. Итак, ждите звонка."),
    (19, "Готова ли карта?", "В предоставленных фрагментах карта готова ,  а счёт открыт !Далее ждите"),
    (20, "Открыт ли счёт?", "[12] Номер счёта, ещё не открыт. Узнайте больше на сайте банка. Зайдите в отделение."),
    (21, "", ""),
    (22, "Как узнать номер?", None),
    (23, "Какой срок?", "Обратите внимание, что потребуется уточнить ставку, срок. <!-- скрыто --> Мы рады вам помочь! Подробнее на сайте банка."),
    (24, "Есть ли ответ?", "Нет прямого ответа на вопрос клиента."),
    (25, "Готова ли карта?", "我们 карта готова к выдаче в банке"),
    (26, "Готова ли карта?", "Карта готова к выдаче на основе контекста. Обратитесь в отделение."),
    (27, "Что это?", "* * * * * * * * * * * * * * * * * *"),
    (28, "Зачислены ли?", "Чтобы проверить, зачислены ли"),
    (29, "Сколько стоит перевод?", "Перевод между своими счетами ничего не стоит. За перевод в другой банк нужно заплатить один процент. Погода хорошая."),
    (30, "Где мои деньги?", "Исходя из контекста, ответ: где мои деньги, банк не знает."),
    (31, "Куда идти?", None),
]

WORD = r"[\p{L}\p{M}\p{N}_]"


def _quoted(x: str | int | None) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


#: Every turn of the conversations with one of the phrases before it, after it, or in place of all but its role.
RU = "phrases(id, query, text) AS (VALUES " + ", ".join(f"({', '.join(map(_quoted, r))})" for r in ROWS) + f"""),
ru AS (
  SELECT c.conv_id * 1000 + c.turn AS id, p.query,
         CASE (c.conv_id + c.turn) % 3 WHEN 0 THEN p.text || ' ' || coalesce(c.text, '') WHEN 1 THEN coalesce(c.text, '') || ' ' || p.text
         ELSE p.text || CASE WHEN c.turn > 3 THEN ' ' || c.role ELSE '' END END AS text
  FROM conversations c JOIN phrases p ON p.id = (c.conv_id * 7 + c.turn) % {len(ROWS)} + 1)"""


def pattern(p: str, flags: str = "i") -> str:
    """A Java pattern as a DuckDB literal, where it needs no more than other spellings of its classes."""
    p = p.replace(r"[_\W]", r"[^\p{L}\p{M}\p{N}]").replace(r"[^\w]", r"[^\p{L}\p{M}\p{N}_]").replace(r"\w", WORD)
    p = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", p).replace(r".*?(?=\n|$)", r"[^\n]*")
    return _quoted((f"(?{flags})" if flags else "") + p)


def bounded(p: str) -> str:
    """With a class before and behind instead of word boundaries, for patterns that are only looked for."""
    out = rf"[^\p{{L}}\p{{M}}\p{{N}}_]"
    head, tail = p.startswith(r"\b"), p.endswith(r"\b")
    core = p.removeprefix(r"\b").removesuffix(r"\b")
    return (f"(?:^|{out})" if head else "") + f"(?:{core})" + (f"(?:$|{out})" if tail else "")


def sub(x: str, p: str, to: str = "", flags: str = "i") -> str:
    return f"regexp_replace({x}, {pattern(p, flags)}, {to if to.startswith('chr') else _quoted(to)}, 'g')"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def sub_bounded(x: str, p: str) -> str:
    """Without matches of a pattern that starts at a word boundary."""
    return sub(x, rf"(^|[^\w])(?:{p.removeprefix(chr(92) + 'b')})".replace(r"[^\w]", r"[^\p{L}\p{M}\p{N}_]"), r"\1")


def clean_text(x: str) -> str:
    """Documents before chunking, without entities."""
    first, *rest = P.SERVICE_PHRASES
    x = sub(f"coalesce({x}, '')", P.HTML_TAG, " ", "")
    x = sub(x, first.replace(r"(?=[.!?\n]|$)", r"([.!?\n]|$)"), r" \1", "is")
    x = sub(x, "|".join(f"(?:{p.replace('(?=', '(?:')})" for p in rest), " ", "is")
    x = sub(sub(sub(x, P.SPECIAL_SPACES, " ", ""), P.MANY_SPACES, " ", ""), P.MANY_NEWLINES, "\n\n", "")
    return strip(x)


def context_sentence(x: str) -> str:
    x = sub(strip(sub(x, P.CONTEXT_HEADER)), P.PASSWORD_RUN)
    return strip(sub(sub(x, P.TRAILING_CONTEXT), r"\s+", " "))


def clean_reference(x: str) -> str:
    x = sub(context_sentence(f"coalesce({x}, '')"), P.REFERENCE_PREAMBLE)
    x = sub_bounded(x, P.REFERENCE_PHRASE)
    for p, to in [(P.REFERENCE_SENTENCE, ""), (P.REFERENCE_FILLER, " "), (P.REFERENCE_LABEL, ""), (P.CONTEXT_MARKER, "")]:
        x = sub(x, p, to)
    x = sub(strip(x), r"\s+", " ")
    for p, to in [(r"\s+([,.;:?!])", r"\1"), (r"([.。!?])\s*([А-Яа-яЁё])", r"\1 \2"), (r"\s*[,;:]\.\s*", ". "), (r"\.{2,}", ".")]:
        x = sub(x, p, to, "")
    return strip(x)


_LEAD = r'[ «"—\-:]*'


def preamble(x: str) -> str:
    core = P.PREAMBLE.removeprefix("^")
    return strip(sub(f"regexp_replace({x}, {pattern(rf'^(?:{_LEAD}(?:{core}))*{_LEAD}')}, '')", P.TRAILING_FRAGMENT))


def markers(x: str) -> str:
    return strip(sub(x, P.CONTEXT_MARKER))


#: A word that is three or more copies of four letters or more, as its unit; null otherwise.
_UNIT = """CASE WHEN regexp_full_match({w}, '[A-Za-zА-Яа-яЁё]{{12,}}') THEN list_max(list_transform(list_filter(range(4, length({w}) // 3 + 1),
lambda n: length({w}) % n = 0 AND lower(repeat({w}[1:n], (length({w}) // n)::BIGINT)) = lower({w})), lambda n: n)) END"""


def cleaned(source: str, key: str, name: str = "cleaned") -> str:
    """CTEs up to ``name(key, answer)`` from ``source(key, answer)``: a generated answer without what it repeats."""
    x = markers(preamble("coalesce(answer, '')"))
    for p, to, flags in [
        (P.REFERENCE_HEADER, "\n", "is"), (P.REFERENCE_END, "\n", "is"), (P.CONTEXT_HEADER_BLOCK, "\n", "i"),
        (P.CONTEXT_HEADER, "", "i"), (P.INLINE_CONTEXT_HEADER, "\n", "i"), (P.PROMPT_LABEL_LINE, "", "is"),
        (P.NO_ANSWER_CONTEXT, "", "is"), (P.NO_ANSWER_CONTEXT_DOT, "", "is"), (P.PROMPT_LEAK, "", "is"),
    ]:
        x = sub(x, p, to, flags)
    x = sub_bounded(x, P.QUESTION_CONTEXT)
    for p, flags in [(P.INSTRUCTION_LEAK, "i"), (P.BASED_ON_CONTEXT, "i"), (P.PASSWORDS, "i"), (P.NUMERIC_ANSWER, "")]:
        x = sub(x, p, "", flags)
    runs = rf"regexp_extract_all(t, '{WORD}+|[^\p{{L}}\p{{M}}\p{{N}}_]+')"
    # repeated units and words: of a run of equal words between spaces, every second one goes with the space before it
    return f"""{name}0 AS (SELECT {key}, {x} AS t FROM {source}),
{name}1 AS (SELECT {key}, t, unnest({runs}) AS w, generate_subscripts({runs}, 1) AS i FROM {name}0),
{name}2 AS (SELECT {key}, i, CASE WHEN {_UNIT.format(w='w')} IS NOT NULL THEN w[1:{_UNIT.format(w='w')}] ELSE w END AS w FROM {name}1),
{name}3 AS (SELECT *, regexp_matches(w, '^{WORD}') AS is_word, lag(w) OVER s AS sep, lag(w, 2) OVER s AS before FROM {name}2 WINDOW s AS (PARTITION BY {key} ORDER BY i)),
{name}4 AS (SELECT *, is_word AND coalesce(lower(before) = lower(w) AND regexp_full_match(sep, '\\s+'), false) AS again FROM {name}3),
{name}5 AS (SELECT *, sum(CASE WHEN is_word AND NOT again THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY i) AS run FROM {name}4),
{name}6 AS (SELECT *, is_word AND (row_number() OVER (PARTITION BY {key}, run, is_word ORDER BY i)) % 2 = 0 AS gone FROM {name}5),
{name}7 AS (SELECT *, coalesce(lead(gone) OVER (PARTITION BY {key} ORDER BY i), false) AND NOT is_word AS gap FROM {name}6),
{name}8 AS (SELECT {key}, string_agg(w, '' ORDER BY i) AS t FROM {name}7 WHERE NOT gone AND NOT gap GROUP BY {key}),
{name} AS (SELECT {name}0.{key}, {strip(sub(f"coalesce({name}8.t, '')", r'\s+', ' '))} AS answer FROM {name}0 LEFT JOIN {name}8 USING ({key}))"""


def meaningful(x: str) -> str:
    stop = ", ".join(map(repr, P.STOP_WORDS))
    edges = P.WORD_EDGES.replace("'", "''")
    return f"list_distinct(list_transform(list_filter({words(f'lower({x})')}, lambda w: length(w) > 2 AND w NOT IN ({stop})), lambda w: trim(w, '{edges}')))"


def valid(query: str, answer: str, least: int) -> str:
    asked = meaningful(query)
    return f"({strip(answer)} <> '' AND (len({asked}) = 0 OR len(list_intersect({asked}, {meaningful(answer)})) >= {least}))"


def mixed_script(x: str) -> str:
    found = P.MIXED_SCRIPT.removeprefix(r"(?<!\w)").removesuffix(r"(?!\w)")
    found = f"regexp_extract_all({x}, {pattern(rf'(?:^|[^\w])({found})(?:$|[^\w])', '')}, 1)"
    allowed = ", ".join(map(repr, P.ALLOWED_LATIN))
    return f"len(list_filter({found}, lambda m: lower(regexp_replace(m, '[^A-Za-z]', '', 'g')) NOT IN ({allowed}))) > 0"


def question_only(x: str) -> str:
    asked, said = meaningful(strip(x)), meaningful(f"regexp_replace({strip(x)}, '[.!?]', ' ', 'g')")
    return (
        f"(length({strip(x)}) - length(replace({strip(x)}, '?', '')) >= 2 AND length({strip(x)}) <= 220"
        f" AND regexp_matches({strip(x)}, {pattern(P.QUESTION_ONLY_CHARS, '')}) AND len({asked}) > 0 AND len({said}) > 0"
        f" AND len(list_intersect({asked}, {said})) >= greatest(2.0, len({asked}) * 0.75))"
    )


def garbage(x: str) -> str:
    """Whether a text, not null, is no answer."""
    allowed = ", ".join(map(repr, P.ALLOWED_LATIN))
    plain = rf"regexp_replace({x}, '(?i)https?://\S+', ' ', 'g')"
    runs = f"regexp_extract_all({plain}, '{WORD}+')"
    rules = [f"length({strip(x)}) < 10"]
    rules += [f"contains(lower({x}), {_quoted(p)})" for p in P.GARBAGE_PHRASES]
    for p, flags in [
        (P.PROMPT_LEAK, "is"), (bounded(P.QUESTION_CONTEXT), "is"), (P.PROMPT_LABEL_LINE, "is"), (P.NO_ANSWER_CONTEXT, "is"),
        (P.NO_ANSWER_ONLY, "i"), (bounded(P.NO_DIRECT_ANSWER), "i"), (bounded(P.NO_ANSWER_PHRASE), "i"), (P.INSTRUCTION_LEAK, "i"),
        (P.BASED_ON_CONTEXT, "i"), (P.PASSWORDS, "i"), (P.REPEAT_PUNCTUATION, ""), (P.DUPLICATED_QUESTION, "is"),
        (P.INCOMPLETE_ANSWER, "i"), (P.NUMERIC_ANSWER, ""), (P.SUSPICIOUS_SCRIPT, ""),
    ]:
        rules.append(f"regexp_matches({x}, {pattern(p, flags)})")
    rules.append(f"len(list_filter(regexp_extract_all({x}, '{WORD}+'), lambda w: ({_UNIT.format(w='w')}) IS NOT NULL)) > 0")
    # a start of two to four letters, nine times
    letters = r"regexp_split_to_array({}, '[^\p{{L}}\p{{M}}\p{{N}}]+')".format(x)
    rules.append(
        f"len(list_filter({letters}, lambda w: len(list_filter(range(2, 5), lambda n: regexp_full_match(w[1:n], '[A-Za-zА-Яа-яЁё]+')"
        " AND length(w[1:n]) = n AND starts_with(lower(w), lower(repeat(w[1:n], 9))))) > 0)) > 0"
    )
    rules += [question_only(x), mixed_script(x)]
    rules.append(
        rf"len(list_filter(regexp_split_to_array({plain}, '[^\p{{L}}\p{{M}}\p{{N}}_-]+'), lambda w: regexp_full_match(w, '[A-Za-z][A-Za-z0-9_-]{{2,}}')"
        rf" AND lower(regexp_replace(w, '[^A-Za-z0-9]', '', 'g')) NOT IN ({allowed}))) > 0"
    )
    rules.append(f"(len({runs}) > 20 AND list_max(map_values(list_histogram({runs}))) > len({runs}) * 0.3)")
    rules.append(rf"length({plain}) - length(regexp_replace({plain}, '\p{{Nd}}', '', 'g')) > greatest(length({plain}), 1) * 0.7")
    return "(" + "\n  OR ".join(rules) + ")"


_WHITE = r"[ \t\r\n\v\f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_EDGE = r"(^|[^\p{L}\p{N}])"
_HEADS = "г|ул|пр|просп|пер|пл|д|кв|корп|оф|стр|им|тел|св|проф|акад|доц|гл|рис|табл|см|ср|напр|т[.]? ?е|т[.]? ?к|Mr|Mrs|Ms|Dr|Prof|St|vs|Fig|e[.]g|i[.]e"
_TAILS = "гг|вв|руб|коп|тыс|млн|млрд|долл|др|проч|мин|сек|кг|км|Inc|Ltd|Corp|etc|al|a[.]m|p[.]m"
_PAIRS = "т[.] ?[дп]|н[.] ?э"


def sentences(x: str) -> str:
    """Sentences of a text: its pieces up to each candidate, with a mark after those that don't go on."""
    quoted = lambda r: "'" + r.replace("'", "''") + "'"
    bare = lambda y: f"regexp_replace({y}, '^{_WHITE}|{_WHITE}$', '', 'g')"
    at = lambda k: f"coalesce(p[k{k}], '')"
    ends = lambda words: f"regexp_matches(w.l, {quoted(_EDGE + '(' + words + ')[.]$')})"
    has = lambda side, r: f"regexp_matches(w.{side}, {quoted(r)})"
    goes_on = " OR ".join([
        has("r", r"""^([«“„"'(\[]*\p{Ll}|[—–-][ \t]*\p{Ll}|[.,:;!?…%)\]»”])"""),
        ends(r"\p{Lu}"),
        f"({ends(_HEADS)} AND NOT {ends(_PAIRS)})",
        f"(({ends(_TAILS)} OR {ends(_PAIRS)}) AND {has('r', r'^\p{N}')})",
        f"({has('o', r'^(((\p{N}{1,3}[.])*\p{N}{1,3}|[IVXLC]{1,5})[.)]+|\p{L}[)][.]?)$')} AND NOT {has('b', f'{_EDGE}({_HEADS}|{_TAILS}|{chr(92)}p{{Lu}})[.]$')})",
        f"({has('l', r'[(][^()]{0,300}$')} AND {has('w', r'^[^()]{0,300}[)]')})",
        f"({has('l', '«[^«»]{0,300}$')} AND {has('w', '^[^«»]{0,300}»')})",
        f"({has('l', '“[^“”]{0,300}$')} AND {has('w', '^[^“”]{0,300}”')})",
        f"""({has('l', r'(^|[\s(])"[^"\s][^"]{0,300}$')} AND {has('w', r'^[^"]{0,300}[^"\s]"([\s.,;:!?…)]|$)')})""",
    ])
    pieces = f"regexp_extract_all(coalesce({x}, ''), {quoted(r"""(?s).*?[.!?…;]+[»”’"')\]]*[ \t\r\n]+|(?s).+""")})"
    left, rest = f"right({bare("array_to_string(p[1:k], '')")}, 310)", "array_to_string(p[k + 1:], '')"
    sides = f"[{{'o': {bare('p[k]')}, 'b': {bare(at(-1))}, 'l': {left}, 'r': regexp_replace({rest}, '^{_WHITE}', '')[1:310], 'w': ' ' || {rest}[1:310]}}]"
    judged = f"list_transform({sides}, lambda w: {goes_on})[1]"
    marked = f"array_to_string(list_transform(range(1, len(p) + 1), lambda k: p[k] || CASE WHEN {judged} THEN '' ELSE chr(1) END), '')"
    parts = f"string_split(list_transform([{pieces}], lambda p: {marked})[1], chr(1))"
    return f"list_filter(list_transform({parts}, lambda s: {bare('s')}), lambda s: s <> '')"


def cut(x: str, marks: list[str], least: str) -> str:
    """For each mark: the text up to its last place, if that is beyond ``least``."""
    at = lambda m: f"(length({x}) - strpos(reverse({x}), '{m}'))"
    return ", ".join(f"CASE WHEN strpos({x}, '{m}') > 0 AND {at(m)} > {least} THEN {x}[1:{at(m)} + 1] END" for m in marks)


def short(source: str, key: str, name: str) -> str:
    """CTEs up to ``name(key, answer)``: answers of five sentences and 550 characters at most."""
    return f"""{name}0 AS (SELECT {key}, answer AS t, {sentences('answer')} AS s FROM {source}),
{name}1 AS (SELECT {key}, CASE WHEN len(s) <= 5 THEN t ELSE array_to_string(s[1:5], ' ') END AS t FROM {name}0),
{name} AS (SELECT {key}, {strip(f"CASE WHEN length(t) <= 550 THEN t ELSE coalesce({cut('t[1:550]', ['.', '!', '?', '»'], '165')}, CASE WHEN strpos(t[1:550], ' ') > 0 AND 550 - strpos(reverse(t[1:550]), ' ') > 275 THEN t[1:550 - strpos(reverse(t[1:550]), ' ')] END, t[1:550]) END")} AS answer FROM {name}1)"""


def posted(source: str, key: str, name: str) -> str:
    """CTEs up to ``name(key, answer)``: generated answers cleaned and shortened."""
    return f"{cleaned(source, key, name + 'c')}, {short(name + 'c', key, name)}"


_JUNK = "|".join(bounded(p) if p.startswith(r"\b") or p.endswith(r"\b") else p for p in P.JUNK_SENTENCES)
JUNK = pattern(_JUNK)
LABEL = pattern(P.PROMPT_LABEL)
_INFORMATIVE = sorted({w.split()[-1] for p in P.INFORMATIVE for w in p.removeprefix(r"\b(").removesuffix(r")\b").split("|")})


def matches(word: str, text: str) -> str:
    """Whether a text holds a word, or the word less one of its usual endings."""
    ends = ", ".join(map(repr, P.ENDINGS))
    return f"(contains({text}, {word}) OR len(list_filter([{ends}], lambda e: ends_with({word}, e) AND contains({text}, {word}[1:length({word}) - length(e)]))) > 0)"


def scored(source: str) -> str:
    """CTEs up to ``sc(q_id, pos, sentence, score)`` for ``source(q_id, query, answer)``, the answer being the context."""
    marks = ", ".join(map(repr, _INFORMATIVE))
    return f"""sents AS (
  SELECT q_id, list_filter(list_transform({sentences("coalesce(answer, '')")}, lambda s: {context_sentence('s')}),
         lambda s: s <> '' AND NOT regexp_matches(s, {LABEL})) AS ss,
         list_distinct({words("translate(lower(coalesce(query, '')), 'ё', 'е')")}) AS w0 FROM {source}),
words AS (SELECT q_id, ss, CASE WHEN len(list_filter(w0, lambda w: length(w) > 2)) > 0 THEN list_filter(w0, lambda w: length(w) > 2) ELSE w0 END AS ws FROM sents),
sen AS (SELECT q_id, len(ss) AS n, len(ws) AS nw, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS pos FROM words),
wd AS (SELECT q_id, unnest(ws) AS w FROM words),
hit AS (SELECT sen.q_id, pos, w, n FROM sen JOIN wd ON wd.q_id = sen.q_id AND {matches('w', "translate(lower(s), 'ё', 'е')")}),
idf AS (SELECT q_id, w, ln((min(n) + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM hit GROUP BY q_id, w),
tf AS (SELECT q_id, pos, sum(idf) AS t FROM hit JOIN idf USING (q_id, w) GROUP BY q_id, pos),
sc AS (
  SELECT sen.q_id, CAST(pos AS INTEGER) AS pos, s AS sentence,
         round(coalesce(t / nw, 0.0) * (1.0 - pos / n * 0.1)
           + least(0.1 * len(list_filter(regexp_extract_all(lower(s), '{WORD}+'), lambda w: w IN ({marks}))), 0.3), 9) AS score
  FROM sen LEFT JOIN tf USING (q_id, pos)
  WHERE NOT regexp_matches(s, {JUNK}) AND len({words('s')}) BETWEEN 1 AND 60)"""


def extracted(source: str) -> str:
    """CTEs up to ``ext(q_id, answer)`` for ``source(q_id, query, answer)``, the answer being the context."""
    return f"""{scored(source)},
top AS (SELECT q_id, string_agg(sentence, ' ' ORDER BY pos) AS t
  FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, pos) AS place FROM sc) WHERE place <= 2 GROUP BY q_id),
picked AS (SELECT q_id, {strip(f"regexp_replace({context_sentence('t')}, {LABEL}, '')")} AS answer FROM top),
{short('picked', 'q_id', 'brief')},
spare AS (SELECT q_id, coalesce(list_filter(ss, lambda s: len({words('s')}) >= 2 AND NOT regexp_matches(s, {JUNK}))[1], '') AS t FROM sents),
ext AS (SELECT sents.q_id, CASE WHEN picked.answer IS NULL THEN spare.t WHEN regexp_matches(picked.answer, {LABEL}) THEN '' ELSE brief.answer END AS answer
  FROM sents JOIN spare USING (q_id) LEFT JOIN picked USING (q_id) LEFT JOIN brief USING (q_id))"""


def folded(source: str, size: int, overlap: int, least: int, name: str) -> str:
    """CTEs up to ``name(key, pos, text)``: the sentences of ``source(key, ss)`` folded into chunks."""
    return f"""{name}_s AS (SELECT key, pos, ss[pos] AS s, length(ss[pos]) AS n FROM (SELECT key, ss, unnest(range(1, len(ss) + 1)) AS pos FROM {source})),
{name}_f(key, pos, buf, cnt, out) AS (
  SELECT DISTINCT key, 0::BIGINT, []::VARCHAR[], 0::BIGINT, []::VARCHAR[] FROM {name}_s
  UNION ALL
  SELECT g.key, g.pos,
    CASE WHEN g.n > {size} THEN [] WHEN g.fits THEN list_append(g.buf, g.s) ELSE list_append(g.tail, g.s) END,
    CASE WHEN g.n > {size} THEN 0 WHEN g.fits THEN g.grown
      ELSE g.cnt - coalesce(list_sum(list_transform(g.buf[1:len(g.buf) - len(g.tail)], lambda x: length(x) + 1)), 0)::BIGINT
        + g.n + CASE WHEN len(g.tail) > 0 THEN 1 ELSE 0 END END,
    CASE WHEN g.n > {size} THEN CASE WHEN len(g.buf) > 0 THEN [array_to_string(g.buf, ' '), g.s] ELSE [g.s] END
      WHEN g.fits THEN [] ELSE [array_to_string(g.buf, ' ')] END
  FROM (
    SELECT f.key, s.pos, s.s, s.n, f.buf, f.cnt, f.cnt + s.n + CASE WHEN len(f.buf) > 0 THEN 1 ELSE 0 END AS grown,
      len(f.buf) = 0 OR f.cnt + s.n + 1 <= {size} AS fits,
      f.buf[1 + coalesce(list_min(list_filter(range(0, len(f.buf) + 1), lambda k:
        f.cnt - coalesce(list_sum(list_transform(f.buf[1:k], lambda x: length(x) + 1)), 0) <= {overlap})), len(f.buf)):] AS tail
    FROM {name}_f f JOIN {name}_s s ON s.key = f.key AND s.pos = f.pos + 1) g),
{name}_c AS (
  SELECT key, pos, 0 AS k, unnest(out) AS text, generate_subscripts(out, 1) AS j FROM {name}_f
  UNION ALL
  SELECT key, pos, 1, array_to_string(buf, ' '), 1 FROM {name}_f
  WHERE len(buf) > 0 AND (key, pos) IN (SELECT key, max(pos) FROM {name}_f GROUP BY key)),
{name} AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos, k, j) - 1 AS pos, text FROM {name}_c WHERE length(text) >= {least})"""


def long_sentences(x: str) -> str:
    return f"list_filter({sentences(x)}, lambda s: regexp_matches(s, '\\s'))"


def windows(source: str, size: int, overlap: int) -> str:
    """CTEs up to ``win(key, pos, text)``: a window over the sentences of ``source(key, ss)`` that steps back."""
    return f"""sums AS (SELECT key, ss, len(ss) AS n, list_transform(range(0, len(ss) + 1), lambda i: coalesce(list_sum(list_transform(ss[1:i], lambda x: length(x))), 0)::BIGINT) AS pf
  FROM {source} WHERE len(ss) > 0),
steps(key, a, b, next) AS (
  SELECT key, 0::BIGINT, 0::BIGINT, 1::BIGINT FROM sums
  UNION ALL
  SELECT key, a, b, b + 1 - least(greatest(coalesce(list_min(list_filter(range(1, b - a + 2), lambda r: pf[b + 1] - pf[b + 1 - r] >= {overlap})), b - a + 1), 1), b - a)
  FROM (SELECT steps.key, pf, steps.next AS a,
      list_max(list_filter(range(steps.next, least(n, steps.next + {size}) + 1), lambda k: k = steps.next OR pf[k + 1] - pf[steps.next] + k - steps.next <= {size})) AS b
    FROM steps JOIN sums ON sums.key = steps.key AND steps.b < n)),
win AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY a) - 1 AS pos, array_to_string(ss[a:b], ' ') AS text FROM steps JOIN sums USING (key) WHERE a > 0)"""


def clean_chunks(source: str, keys: str, name: str) -> str:
    """CTEs up to ``name(keys, t)``: the texts of ``source(keys, text)`` as parts of a context."""
    x = sub(sub("coalesce(text, '')", P.CHUNK_ID_PREFIX, "", ""), P.CONTEXT_HEADER)
    x = sub(sub(x, P.HTML_TAG, " ", ""), P.BROKEN_ENTITY, " ", "")
    for p, to in [(P.SPECIAL_SPACES, " "), (P.MANY_SPACES, " "), (P.MANY_NEWLINES, "\n\n"), (P.DECORATIVE, "")]:
        x = sub(x, p, to, "")
    return f"""{name}0 AS (SELECT {keys}, regexp_replace({x}, '\\s+$', '') AS t FROM {source}),
{name}1 AS (SELECT {keys}, {strip("CASE WHEN regexp_matches(t, '[.!?»" + '"' + ")]$') OR regexp_extract(t, '(?s)^(.*[.!?»])', 1) = '' THEN t ELSE regexp_extract(t, '(?s)^(.*[.!?»])', 1) END")} AS t FROM {name}0),
{name} AS (SELECT {keys}, CASE WHEN length(t) < 20 THEN '' ELSE t END AS t FROM {name}1)"""
