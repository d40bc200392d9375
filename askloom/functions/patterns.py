"""Fixed values that results depend on: patterns, word lists and limits.

Patterns are in Java's regular-expression syntax; ``i`` and ``s`` below add
flags.  ``U`` makes classes and case folding follow Unicode, ``d`` leaves ``\n``
as the only line end that ``.``, ``^`` and ``$`` know.
"""

from __future__ import annotations


def u(pattern: str) -> str:
    return "(?dU)" + pattern


def iu(pattern: str) -> str:
    return "(?diuU)" + pattern


def ius(pattern: str) -> str:
    return "(?dsiuU)" + pattern


# --- fixed values: cleaning of documents and chunks ---
HTML_TAG = r"<[^>]{1,100}>"
BROKEN_ENTITY = r"&[a-zA-Z]{2,8};?|&#\d{1,5};?"
SPECIAL_SPACES = r"[\xa0\u200b\u200c\u200d\u2060\ufeff\t]+"
MANY_SPACES = r" {2,}"
MANY_NEWLINES = r"\n{3,}"
CHUNK_ID_PREFIX = r"^\s*\[\d+\]\s*"
CONTEXT_HEADER = r"^\s*Контекст\s+для\s+ответа\s+на\s+вопрос\s*:?\s*"
DECORATIVE = r"[|*]{2,}|_{3,}"
SERVICE_PHRASES = [
    r"потребуется уточнить\s+[а-яёa-z\s,]+?(?=[.!?\n]|$)",
    r"обратите внимание[,:]?\s*",
    r"обращаем ваше внимание[,:]?\s*",
    r"уточните у специалиста[.!]?\s*",
    r"при необходимости уточните[^.!?\n]*[.!?]?\s*",
    r"узнайте больше\s+(?:на сайте|в приложении|по телефону)[^.!?\n]*[.!?]?\s*",
    r"подробнее\s+(?:на сайте|в разделе|по ссылке)[^.!?\n]*[.!?]?\s*",
    r"(?:мы\s+)?рады\s+(?:вам\s+)?помочь[.!]?\s*",
    r"свяжитесь с нами[^.!?\n]*[.!?]?\s*",
    r"наши специалисты\s+(?:готовы|помогут)[^.!?\n]*[.!?]?\s*",
    r"\[\s*\d+\s*\]",
    r"<!-{2}.*?-{2}>",
]

# --- fixed values: sentences of a context ---
JUNK_SENTENCES = [
    r"^(а|и|но|да|ну)\s+\w+\s+\w+",
    r"^(согласно\s+фрагменту|согласно\s+предоставленным\s+фрагментам|в\s+предоставленных\s+фрагментах)\b",
    r"^контекст\s+для\s+ответа\b",
    r"^вопрос\s*:?",
    r"^ответ\s*:?",
    r"^нет\s+ответа\s*(?:\.|[-–—])?\s*(?:контекст|фрагмент)?",
    r"\bнет\s+ответа\b",
    r"узнайте больше",
    r"подробнее на сайте",
    r"свяжитесь с нами",
    r"мы рады помочь",
    r"спасибо за обращение",
    r"^\d+[\.\)]\s*$",
    r"^\s*(?:\d{1,3}\s*[,.)\-]\s*){2,}$",
    r"^\s*(?:\d{1,3}\s*){3,}$",
    r"^[^\w]+$",
]
INFORMATIVE = [
    r"\b(чтобы|для того чтобы|необходимо|нужно|следует|можно)\b",
    r"\b(зайдите|перейдите|нажмите|выберите|введите|откройте)\b",
    r"\b(позвоните|обратитесь|напишите|заполните)\b",
    r"\b(доступен|доступна|работает|предоставляется)\b",
    r"\b(порядок|способ|шаг|этап|процедура)\b",
]
PROMPT_LABEL = r"^\s*(?:Вопрос|Контекст|Ответ)\s*:?\s*"
PASSWORD_RUN = r"PASSWORD{2,}"
TRAILING_CONTEXT = r"\s*---\s*Контекст.*$"
ENDINGS = ["а", "ы", "и", "ов", "ев", "ой", "ий", "ый", "ом", "ем", "ую", "юю"]

# --- fixed values: cleaning of generated answers ---
PREAMBLE = (
    r"^\s*(?:согласно\s+(?:фрагмент[ауые]*\s*\d*|контекст[ауе]*|предоставленны[мх][^,.:]*)[,:]?\s*"
    r"|в\s+фрагмент[еах]*\s*\d*\s*(?:указано|сказано|говорится)[,:]?\s*"
    r"|таким образом[,:]?\s*"
    r"|исходя из (?:контекста|вышесказанного)[,:]?\s*"
    r"|ответ[:：]\s*)"
)
TRAILING_FRAGMENT = r"\s*\(?\s*фрагмент\s*\d+\s*\)?\.?\s*$"
CONTEXT_MARKER = r"\[?\s*фрагмент\s*\d+\s*\]?[:：]?\s*"
REFERENCE_HEADER = r"\n?\s*===\s*эталонный ответ.*?===\s*\n?"
REFERENCE_END = r"\n?\s*===\s*конец эталонного ответа\s*===\s*\n?"
CONTEXT_HEADER_BLOCK = r"(?:^|\n)\s*-{2,}\s*\n\s*Контекст\s+для\s+ответа\s+на\s+вопрос\s*:?\s*\n\s*"
INLINE_CONTEXT_HEADER = r"\s*---\s*Контекст\s+для\s+ответа\s+на\s+вопрос\s*:?\s*"
PROMPT_LABEL_LINE = (
    r"(?:^|\n)\s*(?:Вопрос|Контекст|Контекст\s+для\s+ответа\s+на\s+вопрос|Ответ|В\s+\w{1,10}|Весь)\s*:.*?(?=\n|$)"
)
NO_ANSWER_CONTEXT = r"\n?\s*Нет\s+ответа\s*[-–—]*\s*Контекст.*$"
NO_ANSWER_CONTEXT_DOT = r"\n?\s*Нет\s+ответа\s*\.?\s*[-–—]*\s*Контекст.*$"
PROMPT_LEAK = r"(?:^|\n)\s*ты\s*—\s*банковский\s+ai-?ассистент.*?(?:правила|примеры).*?(?:\n\s*\d+\.\s+){2,}"
QUESTION_CONTEXT = r"\bвопрос:\s*.*?\s*контекст:\s*"
INSTRUCTION_LEAK = r"(?:---\s*)?ответь кратко.*?(?:контекста|вопроса)?\.?"
BASED_ON_CONTEXT = r"\s*на основе контекста\.?"
PASSWORDS = r"(?:PASSWORD){2,}"
NUMERIC_ANSWER = (
    r"^\s*(?:\d{1,3}\s*[,.)\-]\s*){2,}$|^\s*(?:\d{1,3}\s*){3,}$|^\s*(?:\d{1,3}\s*[./]\s*){7,}$"
)
REPEAT_BLOCK = r"\b([A-Za-zА-Яа-яЁё]{4,})\1{2,}\b"
REPEAT_TOKEN = r"\b(\w+)\s+\1\b"

# --- fixed values: garbage answers ---
REPEAT_SHORT_TOKEN = r"(?:^|[_\W])([A-Za-zА-Яа-яЁё]{2,4})(?:\1){8,}"
REPEAT_PUNCTUATION = r"^\s*(?:[*#_\-/\\|])\s*(?:[*#_\-/\\|]\s*){15,}$"
DUPLICATED_QUESTION = (
    r"(?:^\s*.{5,140}\?\s+[А-Яа-яЁё][^.!?]{20,}|на\s+вопрос\s*[\"']?.{5,100}\?\s*.{5,100}\?)"
)
INCOMPLETE_ANSWER = (
    r"(?:зачислены\s+ли|поступили\s+ли\s+средства|проверить,\s+зачислены\s+ли"
    r"|есть\s+несколько\s+способов\s+проверить,\s+зачислены\s+ли)$"
)
NO_ANSWER_ONLY = r"^\s*Нет\s+ответа\.?\s*(?:[-–—]+\s*)?$"
NO_ANSWER_PHRASE = r"\bнет\s+ответа\b"
NO_DIRECT_ANSWER = r"^\s*нет\s+прямого\s+ответа\s+на\s+вопрос\b"
QUESTION_ONLY_CHARS = r"^[А-Яа-яЁёA-Za-z0-9\s,.;:!?'’\"«»()\\-]+$"
GARBAGE_PHRASES = [
    "контекст для ответа", "ответь кратко", "согласно фрагменту", "в предоставленных фрагментах", "с muslimно",
    "internet-бitter", "т_mm — банковский", "oeет ответа", "микроб", "icrobialatedi", "container", "vacation",
    "politely", "recipe", "correo", "totalitarian", "impонтекст", "где мои деньги", "предоставьте вопрос",
    "без вопроса я не могу", "sat.", "sat ", "sat,", "ты — банковский ai", "эталонный ответ",
    "конец эталонного ответа",
]
SUSPICIOUS_SCRIPT = (
    r"[\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\uac00-\ud7af"
    r"\u1100-\u11ff\u3040-\u30ff\u3130-\u318f\u3400-\u4dbf\u4e00-\u9fff"
    r"\u0e00-\u0e7f\u0900-\u097f\u0980-\u09ff\ufffd]"
)
MIXED_SCRIPT = (
    r"(?<!\w)(?:[A-Za-z]+[_\-—:;,.()\"']{0,3}[А-Яа-яЁё]+|[А-Яа-яЁё]+[_\-—:;,.()\"']{0,3}[A-Za-z]+)(?!\w)"
)
LATIN_TOKEN = r"(?<![\w-])[A-Za-z][A-Za-z0-9_-]{2,}(?![\w-])"
ALLOWED_LATIN = [
    "alfa", "alfabank", "alpha", "visa", "mastercard", "maestro", "mir", "telegram", "whatsapp", "vkontakte", "vk",
    "facebook", "google", "apple", "android", "ios", "samsung", "pay", "googlepay", "applepay", "samsungpay", "swift",
    "sepa", "api", "url", "sms", "pin", "iban", "bic", "qr", "pos", "cvv", "3ds", "secure", "online", "bank", "id",
    "ip", "wi", "fi", "cashback", "hold", "number", "push",
]
STOP_WORDS = [
    "как", "что", "где", "когда", "почему", "зачем", "кто", "можно", "нужно", "надо", "это", "есть", "для", "при",
    "или", "если", "чтобы", "который", "которая", "которое", "в", "на", "с", "по", "из", "от", "до", "за", "к", "у",
    "я", "мы", "вы", "он", "она", "они",
]
WORD_EDGES = ".,!?;:\"'()[]"

# --- fixed values: reference answers ---
REFERENCE_PREAMBLE = (
    r"^\s*(?:согласно\s+(?:предоставленным\s+)?фрагмент[а-яё]*\s*\d*[,:]?\s*"
    r"|в\s+фрагмент[еах]*\s*\d*\s*[:：]?\s*"
    r"|в\s+фрагмент[еах]*\s*\d*\s*(?:указано|сказано|говорится)[,:]?\s*)"
)
REFERENCE_LABEL = r"\s*ответ\s*[:：]\s*"
REFERENCE_PHRASE = r"\bв\s+предоставленных\s+фрагментах\s+"
REFERENCE_SENTENCE = (
    r"\s*(?:также,\s*)?в\s+фрагмент[еах]*\s*\d+\s+(?:указан[а-яё]*|сказано|говорится)[^.。!?]*"
)
REFERENCE_FILLER = r"\s*(?:таким образом|итак|следовательно),?\s*"

# --- fixed values: evaluation ---
ACTIONABLE = [
    r"можно|нужно|должен|обязательно|следует|требуется",
    r"зайдите|перейдите|нажмите|выберите|введите|откройте",
    r"позвоните|обратитесь|напишите|заполните",
    r"будет|может|можно|доступен|предоставляется",
]
NO_INFO = "недостаточно информации"
ANSWER_PATTERNS = {
    "has_phone": r"8\s*\(?\d{3,4}\s*\)?[\d\s\-]{6,}",
    "has_bik": r"БИК",
    "has_account": r"с[ёе]т[ьч]",
    "has_app": r"приложение|мобильн",
    "has_contact": r"обратиться|техподдерж",
}
LENGTH_BINS = [0, 50, 100, 150, 200, 250, 300, 400, 500]
LENGTH_LABELS = ["0-50", "51-100", "101-150", "151-200", "201-250", "251-300", "301-400", "401+"]

# --- fixed values: texts that users see ---
REWRITE_PREFIX = "Уточни: "
PIPELINE_VERSION = "v7-parent-child-rag"
