"""Broken prompt and response pairs.

Every pair of a question and an answer is judged by its answer: ``empty``,
``refusal``, ``copy``, ``language`` or ``truncated``; a pair has one defect, the
first of this order that holds.

* refusal: every clause of the answer is aligned with refusal templates by
  shingle containment and longest common subsequence;
* copy: the answer is aligned with its question in the same way; only a frame or
  a slight change may be left over;
* language: function words of the answer against those of the question;
* truncated: dangling ends, and ends at which the corpus' answers of the same
  wording go on. For this all distinct pairs are counted by the last words before
  each position, once per corpus; copies and redeliveries add nothing.

Defined results: null questions make no copy and no language defect; rows
without an id are left out; repeated rows give one result; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.lexicon import common_words
from folioframe.plans.staging import spread, stage

DEFECTS = ("empty", "refusal", "copy", "language", "truncated")

#: Answers that only fill the field, in lower case without outer blanks.
FILLERS = frozenset("n/a na n.a. null none nil nan undefined tbd todo empty (empty) [empty] <empty> (none) [none] <none> (null) [null] <null> [blank] <blank> <answer> [answer] answer: a: placeholder [placeholder] xxx ??? lorem".split())

#: Refusal templates, one per line; an answer with a clause that opens with one declines to answer.
REFUSALS = """
i cannot answer this
i cannot answer this question
i cannot help with that
i can't help with that request
i can not answer that
we cannot answer this question
we are unable to answer this question
i cannot determine this
i cannot read the page
i could not open the file
i was unable to read the page
i have no access to the document
i am unable to answer
i am unable to read the image
i am unable to help
i'm unable to answer
i'm not able to answer
i'm not able to view attachments
i am not able to provide an answer
i won't be able to provide an answer here
i will not answer this
i must decline to answer
i have to decline
i decline to answer
i don't have enough context to respond
i do not have enough information to answer
i don't have access to the document
i do not have access to the document
i can't see the image
i cannot see the page
i can't open the file
i cannot view the image
i cannot provide an answer
i can't provide that
it is not possible for me to determine this
it's not possible for me to answer
answering this is beyond what i can do
this is beyond my abilities
no answer can be given by me without seeing the page
as an ai assistant i
as an ai language model i
leider kann ich diese frage nicht beantworten
kann ich diese frage nicht beantworten
ich kann diese frage nicht beantworten
ich kann dabei nicht helfen
habe ich keinen zugriff auf das dokument
ich habe keinen zugriff auf das dokument
ist es mir nicht möglich das bild zu lesen
es ist mir nicht möglich das bild zu lesen
als ki kann ich
je ne peux pas répondre à cette question
je ne suis pas en mesure de répondre
je n'ai pas accès au document
il m'est impossible de lire l'image
je ne peux pas vous aider
je ne dispose pas d'informations suffisantes
no puedo responder a esta pregunta
no puedo ayudar con eso
no tengo acceso al documento
me resulta imposible leer la imagen
no me es posible responder
no dispongo de información suficiente
""".strip().split("\n")

#: Words that may frame a returned question without answering it.
FRAME = frozenset(
    "question query q asked ask asks asking you your user prompt is was the this here that to answer only use page image images "
    "give final and nothing else s reads about following repeat wanted know i me a of for my original please respond with "
    "frage lautet die ist gefragt wurde wird la le est demande pregunta es question se pregunta pregunte demandée posée posee "
    "nur bild seite antworte seule réponds uniquement finale responde solo página final".split()
)

#: Function words per language beyond the corpus' table of common words.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it was on are with as by at from this have or an which be not but were their has they its can when than only no if there all about into more because between after under over each both other no nobody none them what who how why where does did it's isn't don't yes he she we our his her",
    "de": "der die das und ist nicht ein eine einen einem einer des dem den mit auf für von im zu zum zur sich als auch es an bei nach wird werden wurde wurden hat haben sind aus nur keine kein keinen weil wegen unter über oder aber dass so am um noch wie was wer warum welche welcher welches ersten beiden links rechts oben unten ja nein gab wenig viel mehr zwischen",
    "fr": "le la les des du de et est une un dans pour que qui sur pas par au aux en ce cette ces il elle ils ne se plus avec sont été était avait ont mais ou où donc car parce qu'il à y trop peu aucun aucune seulement deux premiers très bas haut gauche droite sans entre quelle quel pourquoi oui non d'une d'un l'axe n'est c'est",
    "es": "el la los las de del y es una un en que por para con no se su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también fue había ningún ninguna solo dos primeros abajo arriba izquierda derecha hay demasiado según cuál qué está son ha han se",
    "it": "il lo la i gli le di del della dei delle e è un una in che per con non si al alla nel nella da dal sono come più ma anche o secondo tabella valore nessun nessuna altri altre negli degli perché tra solo figura",
    "pt": "o a os as de do da dos das e é um uma em que por para com não se no na nos nas ao como mais mas foi são acordo tabela valor outras outros nenhum nenhuma porque entre figura sem muda",
    "nl": "de het een van en is niet in op te met voor dat die zijn er aan bij als ook naar uit door geen volgens tabel waarde maar worden wordt dan dit deze omdat tussen alleen blijft andere",
    "pl": "w i z na do się nie jest że to zgodnie z tabelą wartość dla wynosi niższa niż od po przez oraz jak ale lub przy tylko są który która bez według rysunku brak zmian",
    "sv": "och att det i en ett på är av för med som den till inte har de om var från men enligt tabellen värdet än",
    "da": "og at det i en et på er af for med som den til ikke har de om var fra men ifølge tabellen værdien",
    "cs": "a v na je se že z do to s pro podle tabulky hodnota není ale jako která který od po",
    "ro": "și în de la nu este cu pe un o care mai din pentru conform tabelului valoarea dar sau",
    "tr": "ve bir bu da de için ile tabloya göre değeri olarak daha değil çok",
}

#: How a question names a language.
LANGUAGE_NAMES = {
    "en": "english englisch englische englischen anglais anglaise inglés inglesa inglese",
    "de": "german deutsch deutsche deutschen allemand allemande alemán alemana tedesco",
    "fr": "french französisch französische französischen français française francés francesa francese",
    "es": "spanish spanisch spanische spanischen espagnol espagnole español española spagnolo castellano",
    "it": "italian italienisch italien italiano italienne italiana",
    "pt": "portuguese portugiesisch portugais portugués português",
    "nl": "dutch niederländisch néerlandais neerlandés holandés",
    "pl": "polish polnisch polnische polonais polaco",
    "ru": "russian russisch russische russe ruso cyrillic",
    "zh": "chinese chinesisch chinesische chinois chino mandarin",
    "ja": "japanese japanisch japonais japonés",
}

_SCRIPTS = (
    ("zh", re.compile(r"[぀-ヿ㐀-鿿]")),
    ("ko", re.compile(r"[가-힯]")),
    ("ru", re.compile(r"[Ѐ-ӿ]")),
    ("ar", re.compile(r"[؀-ۿ]")),
    ("he", re.compile(r"[֐-׿]")),
    ("el", re.compile(r"[Ͱ-Ͽ]{2}")),
    ("hi", re.compile(r"[ऀ-ॿ]")),
    ("th", re.compile(r"[฀-๿]")),
)
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_INVISIBLE = re.compile(r"[\s ​-‏⁠﻿­]+")
_TOKEN = re.compile(r"[^\W_]+(?:[.,'’/+\-][^\W_]+)*\+?")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_ENDED = re.compile(r"[.!?。！？]['\"”’»)\]]*$|[)\]\"”»]$")
_DANGLING = re.compile(r"(?:…|\.\.+|[,;:(\[{–—-])['\"”’»]*$")
_ABBREVIATION = re.compile(r"(?:\b(?:e\.g|i\.e|z\.\s?b|d\.\s?h|p\.\s?ej|vgl|cf|etc\. and|incl|bzw|resp|fig|abb|tab|approx|vs)\.)$", re.I)
_CLOSED = "because although while when which whose where and or of the a an to from with by for at in on as than that is are was were und oder weil dass der die das den dem des ein eine einer mit von zu bei für et ou de du des le la les un une à au aux avec par pour que qui sur dans est y o el los las del una con por para en al se es"
#: Orders of the word context, long to short; contexts that fewer than SEEN other pairs have say nothing and leave it to the next, at last to false.
ORDERS = (8, 4)
SEEN = 5


def _tokens(text: str) -> list[str]:
    return [t.replace("’", "'") for t in _TOKEN.findall(text.lower())]


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    bare = _INVISIBLE.sub(" ", answer).strip().lower()
    if bare in FILLERS:
        return True
    bare = re.sub(r"</?\w+/?>", "", bare).strip()
    return not any(c.isalnum() for c in bare) and bare not in ("%", "‰", "°", "€", "$", "£", "+", "√", "∞", "✓", "✗", "✔", "✘", "=", "<", ">", "#", "&")


def _lcs(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence of tokens or characters; a whole row of the table is one integer."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    every = row = (1 << len(a)) - 1
    for y in b:
        hit = row & at.get(y, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & every
    return len(a) - row.bit_count()


def _shingles(tokens: list[str], n: int = 2) -> set[tuple[str, ...]]:
    return {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)}


#: Contracted forms and what they stand for.
CONTRACTIONS = {"can't": "cannot", "can not": "cannot", "won't": "will not", "don't": "do not", "couldn't": "could not", "i'm": "i am", "it's": "it is", "we're": "we are"}
_CONTRACTED = re.compile("|".join(rf"\b{re.escape(x)}\b" for x in CONTRACTIONS))


def _spelled_out(low: str) -> str:
    return _CONTRACTED.sub(lambda m: CONTRACTIONS[m.group()], low)


def _refusal_templates() -> dict[str, list[tuple[list[str], set]]]:
    """First token -> (tokens, shingles) of the templates that begin with it."""
    out: dict[str, list[tuple[list[str], set]]] = {}
    for line in REFUSALS:
        tokens = _tokens(_spelled_out(line))
        out.setdefault(tokens[0], []).append((tokens, _shingles(tokens)))
    return out


#: Tokens of the longest template.
LONGEST_TEMPLATE = max(len(x.split()) for x in REFUSALS) + 2
_QUOTED = re.compile(r"[\"“„«][^\"”“»]*[\"”“»]")
#: Where a clause may begin: after a mark, and after a joining word.
_CLAUSE = re.compile(r"[.!?;,\n–—]+|\b(?:but|so|therefore|however|afraid|sorry|aber|daher|mais|donc|pero)\b")
#: A text without any of these words can't be aligned with a template.
_DECLINING = re.compile(r"\b(?:cannot|unable|able|not|no|decline|beyond|ai|nicht|keinen|ki|pas|impossible|puedo|tengo|imposible|posible|dispongo)\b")


def is_refusal(answer: str, templates) -> bool:
    """A clause of the answer, wherever it lies, is one of the templates; quoted refusals and statements about others don't count."""
    text = answer.strip().replace("’", "'")
    if text[:1] in "\"“«„'‘":
        return False
    low = _spelled_out(_QUOTED.sub(" ", _INVISIBLE.sub(" ", text.lower())))
    if not _DECLINING.search(low):
        return False
    marks = [m.end() for m in _CLAUSE.finditer(low)]
    for start in (0, *marks):
        # a clause may be cut by a comma of its own: the template is aligned with what follows its start
        words = [t.replace("’", "'") for t in islice((m.group() for m in _TOKEN.finditer(low, start)), 3 + LONGEST_TEMPLATE + 4)]
        for skip in range(min(3, len(words))):
            for tokens, need in templates.get(words[skip], ()):
                window = words[skip : skip + len(tokens) + 4]
                if len(need & _shingles(window)) >= 0.6 * len(need) and _lcs(tokens, window) >= 0.85 * len(tokens):
                    return True
    return False


def _close(a: str, b: str) -> bool:
    """Equal but for one letter lost, added, changed or two swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4 or any(c.isdigit() for c in a + b):
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and sorted(a[i : i + 2]) == sorted(b[i : i + 2]))


def _slip(a: str, b: str) -> bool:
    """Equal up to one character, blanks aside: all but one of the characters lie in a common subsequence."""
    return abs(len(a) - len(b)) <= 1 and _lcs(a, b) >= max(len(a), len(b)) - 1


def is_copy(question: str | None, answer: str) -> bool:
    """The answer gives the question back: whole, doubled, turned, shortened, framed or with a slip."""
    if not question:
        return False
    q, a = _tokens(question), _tokens(re.sub(r"</?\w+>", " ", answer))
    if len(q) < 3 or len(a) < 3:
        return bool(q) and q == a and answer.rstrip(" \"'”»").endswith("?")
    have = Counter(q)
    foreign = [t for t in a if t not in have and t not in FRAME]
    if len(foreign) > 2 + 0.1 * len(a):
        return False
    if foreign and _slip("".join(q), "".join(a)):
        return True
    foreign = [t for t in foreign if not any(_close(t, x) for x in have)]
    if len(foreign) > max(0, 0.1 * len(a)) or any(any(c.isdigit() for c in t) for t in foreign):
        return False
    met = set(a)
    covered = sum(n for t, n in have.items() if t in met or any(_close(t, x) for x in met)) / len(q)
    asked = answer.rstrip(" \"'”»").endswith("?") or question.rstrip()[-1:] != "?"
    grams = _shingles(a)
    inside = len(grams & _shingles(q)) / len(grams) if grams else 0.0
    along = _lcs(q, a) / len(q)
    if covered >= 0.8 and (inside >= 0.55 or along >= 0.8):
        # a statement made of the question's words answers it, unless it keeps the question's order
        return asked or along >= 0.9 or inside >= 0.8
    return covered >= 0.5 and inside >= 0.8 and (asked or a[:3] == q[:3]) and len(a) >= 5


def _lexicon(common: dict[str, frozenset[str]]) -> dict[str, dict[str, float]]:
    """word -> language -> weight; words of several languages count less."""
    of: dict[str, set[str]] = {}
    for lang, text in FUNCTION_WORDS.items():
        for w in set(text.split()) | set(common.get(lang, ())):
            of.setdefault(w, set()).add(lang)
    return {w: {x: 1.0 / len(langs) for x in langs} for w, langs in of.items()}


_PUNCTUATION = ".,;:!?…\"'“”„«»()[]¿¡"
_MARKS = (
    ("de", re.compile(r"[ß]|[a-z]ung\b|\b\w+keit\b")),
    ("es", re.compile(r"[ñ¿¡]|ción\b|[óíá]n\b")),
    ("pt", re.compile(r"[ãõ]|ção\b|ções\b")),
    ("pl", re.compile(r"[ąęłńśźż]")),
    ("fr", re.compile(r"[œ]|\b[dlnsjmt]['’][a-zéèêà]|qu['’]|[eé]ment\b.*[éèà]")),
    ("cs", re.compile(r"[řěů]")),
    ("ro", re.compile(r"[țș]")),
    ("tr", re.compile(r"[ğıİ]")),
    ("sv", re.compile(r"å")),
)


def scores(text: str, lexicon, drop: frozenset[str] = frozenset()) -> dict[str, float]:
    out: dict[str, float] = {}
    for i, piece in enumerate(text.split()):
        core = piece.strip(_PUNCTUATION)
        if not piece.islower():
            # names and units: capitals inside, digits, or a short capitalised word within the sentence
            if (len(core) > 1 and not core[1:].islower()) or (len(core) == 1 and core.isupper()) or (i and len(core) < 4):
                continue
            core = core.lower()
        found = lexicon.get(core)
        if found and core not in drop:
            for lang, x in found.items():
                out[lang] = out.get(lang, 0.0) + x
    low = text.lower()
    for lang, mark in _MARKS if not low.isascii() or "'" in low else _MARKS[:1]:
        if mark.search(low):
            out[lang] = out.get(lang, 0.0) + 0.6
    return out


def script_of(text: str) -> str | None:
    """A language of another script that has most letters of the text."""
    latin = len(_LATIN.findall(text))
    for lang, rx in _SCRIPTS:
        n = len(rx.findall(text))
        # names stay in Latin letters
        if n >= 2 and n * 2 >= latin * (0.5 if lang in ("zh", "ko") else 1):
            return lang
    return None


def question_language(question: str, lexicon) -> str | None:
    question = question.replace("’", "'")
    if not question.isascii() and (script := script_of(question)) is not None:
        return script
    s = scores(re.sub(r"[\"“„«][^\"”“»]*[\"”“»]", " ", question), lexicon)
    best = sorted(s.items(), key=lambda x: -x[1])[:2]
    return best[0][0] if best and best[0][1] >= 0.5 else None


def _named_languages(question: str) -> set[str]:
    words = set(_WORD.findall(question.lower()))
    return {lang for lang, names in LANGUAGE_NAMES.items() if words & set(names.split())}


def is_other_language(question: str | None, answer: str, lexicon) -> bool:
    if not question:
        return False
    answer = answer.replace("’", "'")
    script = script_of(answer) if not answer.isascii() else None
    if script is None and question.isascii() and not any(v >= 0.5 for v in scores(answer, lexicon).values()):
        return False
    asked = question_language(question, lexicon)
    if asked is None:
        return False
    if script is not None:
        return script != asked and not _named_languages(question)
    if asked in dict(_SCRIPTS):
        return len(_LATIN.findall(answer)) > 12 and not _named_languages(question)
    quoted = frozenset(w.lower() for w in _WORD.findall(question) if w[:1].isupper())
    s = scores(answer, lexicon, quoted)
    own = s.get(asked, 0.0)
    other, best = max(((k, v) for k, v in s.items() if k != asked), key=lambda x: x[1], default=(None, 0.0))
    if other is None or best < 0.5 or best <= 1.5 * own + 0.2:
        return False
    if best < 0.9 and len(_WORD.findall(answer)) > 4:
        return False
    return other not in _named_languages(question)


def skeleton(answer: str, keep: frozenset[str]) -> list[str]:
    """The wording of an answer: function words stay, numbers and all other words are masked."""
    out = []
    for raw in answer.split():
        t = raw.strip("\"'“”«»()[]").lower()
        core = t.rstrip(".,;:!?…")
        tail = "," if t.endswith((",", ";", ":")) else ""
        if not core:
            continue
        out.append((core if core in keep else "#" if re.fullmatch(r"[\d.,%–-]*\d[\d.,%–-]*", core) else "*") + tail)
    return out


def contexts(words: list[str], at: int) -> list[str]:
    """Keys of the last words before position ``at``, one per order."""
    padded = ["^"] * max(ORDERS) + words[:at]
    return [f"{n}:" + " ".join(padded[-n:]) for n in ORDERS]


def dangles(answer: str, keep: frozenset[str], closed: frozenset[str]) -> bool:
    """The end alone shows that something is missing."""
    whole = answer.strip()
    if len(whole) > 2 and whole[0] in "\"'“„«" and whole[-1] in "\"'”“»":
        return False  # a quotation ends where its source does
    text = whole.rstrip("\"'”»")
    words = text.split()
    if len(words) < 2 and not text.endswith(("…", "...")):
        return False
    if _DANGLING.search(text) or _ABBREVIATION.search(text):
        return not re.fullmatch(r"[\d\s.,–—-]+", text) or text.endswith(("…", "...", ","))
    for a, b in ("()", "[]", "{}", "“”", "«»"):
        if whole.count(a) > whole.count(b):
            return True
    if whole.count('"') % 2 and not re.search(r'\d"', whole):
        return True
    if len(words) >= 4 and not _ENDED.search(text):
        last = words[-1].lower()
        return last in closed or (last == words[-2].lower() and last.isalpha())
    return False


def is_ended(answer: str) -> bool:
    return bool(_ENDED.search(answer.strip()))


class Judge:
    """Everything a worker needs to look at single pairs."""

    def __init__(self, common: dict[str, frozenset[str]]):
        self.lexicon = _lexicon(common)
        main = ("en", "de", "fr", "es")
        self.keep = frozenset(w for w, of in self.lexicon.items() if any(x in of for x in main))
        self.prefixes = frozenset(w[:n] for w in self.keep if len(w) >= 4 for n in range(2, len(w))) - self.keep
        self.closed = frozenset(_CLOSED.split())
        self.templates = _refusal_templates()

    def first_defect(self, question: str | None, answer: str | None) -> str | None:
        if is_empty(answer):
            return "empty"
        if is_refusal(answer, self.templates):
            return "refusal"
        if is_copy(question, answer):
            return "copy"
        if is_other_language(question, answer, self.lexicon):
            return "language"
        if dangles(answer, self.keep, self.closed):
            return "truncated"
        return None


def qa_pairs(chat: DataFrame, bench: DataFrame, qa: DataFrame) -> DataFrame:
    """src_table, record_id, item_pos, question, answer of all three tables."""

    def flat(df: DataFrame, name: str, key: str) -> DataFrame:
        return df.select(
            F.lit(name).alias("src_table"), F.col(key).cast("bigint").alias("record_id"), F.lit(0).cast("bigint").alias("item_pos"),
            F.col("query").alias("question"), F.col("answer").alias("answer"),
        )

    items = qa.select(F.col("record_id").cast("bigint").alias("record_id"), F.posexplode("qas").alias("item_pos", "item")).select(
        F.lit("qa_records").alias("src_table"), "record_id", F.col("item_pos").cast("bigint").alias("item_pos"),
        F.col("item.q").alias("question"), F.col("item.a").alias("answer"),
    )
    return (
        flat(chat, "chat_samples", "sample_id")
        .unionByName(flat(bench, "bench_annotations", "ann_id"))
        .unionByName(items)
        .filter("record_id is not null")
    )


_LOOKED = (
    "src_table string, record_id bigint, item_pos bigint, defect string, last array<string>, before array<string>, "
    "cut boolean"
)
_COUNTED = "key string, mid bigint, ended bigint, open bigint"


def look_at_pairs(pairs: DataFrame, common: dict[str, frozenset[str]]) -> DataFrame:
    """One pass over all pairs: defects seen from the pair alone, and pairs whose end needs the corpus. Sound pairs give no row."""

    def run(batches):
        import pandas as pd

        judge = Judge(common)
        names = [c.split()[0] for c in _LOOKED.split(", ")]
        for b in batches:
            rows: list[tuple] = []
            for table, rid, pos, question, answer in zip(b["src_table"], b["record_id"], b["item_pos"], b["question"], b["answer"]):
                defect = judge.first_defect(question, answer)
                if defect is not None:
                    rows.append((table, rid, pos, defect, None, None, None))
                    continue
                if is_ended(answer):
                    continue
                words = skeleton(answer, judge.keep)
                if len(words) >= 3:
                    cut = answer.split()[-1].lower().strip("\"'([") in judge.prefixes
                    n = len(words)
                    rows.append((table, rid, pos, None, contexts(words, n), contexts(words, n - 1), cut))
            out = pd.DataFrame(rows, columns=names)
            for c in ("record_id", "item_pos"):
                out[c] = out[c].astype("Int64")
            yield out

    return spread(pairs).mapInPandas(run, _LOOKED)


def count_wordings(pairs: DataFrame, common: dict[str, frozenset[str]]) -> DataFrame:
    """key, mid, ended, open: how many distinct pairs go on after a wording, end there, or stop there without a mark.

    Texts that differ in letter case or blanks only are one. The same answer to
    another question counts again: sound short answers ("in the spring") are given to many.
    """
    text = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    answers = pairs.filter("answer is not null").select(F.xxhash64(text("question")).alias("asked"), text("answer").alias("answer")).distinct()

    def run(batches):
        import pandas as pd

        keep = Judge(common).keep
        for b in batches:
            wordings: Counter = Counter()
            for answer in b["answer"]:
                if not is_empty(answer) and (words := tuple(skeleton(answer, keep))):
                    wordings[words, is_ended(answer)] += 1
            mid: Counter = Counter()
            last: dict[bool, Counter] = {True: Counter(), False: Counter()}
            for (words, ended), n in wordings.items():
                listed = list(words)
                for i in range(1, len(listed)):
                    for key in contexts(listed, i):
                        mid[key] += n
                for key in contexts(listed, len(listed)):
                    last[ended][key] += n
            rows = [(key, mid[key], last[True][key], last[False][key]) for key in mid.keys() | last[True].keys() | last[False].keys()]
            yield pd.DataFrame(rows, columns=["key", "mid", "ended", "open"])

    return answers.select("answer").mapInPandas(run, _COUNTED).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("mid", "ended", "open")])


def _going_on(name: str, own: int):
    """Whether answers of this wording go on, from a struct of counts; null where the corpus says too little.

    ``own``: endings of the judged answer itself among the open ones, which are no evidence.
    """
    mid, ended, open_ = F.col(f"{name}.mid"), F.col(f"{name}.ended"), F.col(f"{name}.open") - own
    judged = (mid >= SEEN) & (ended < 0.01 * (mid + ended)) & (open_ <= 0.05 * (mid + open_))
    return F.when(mid + ended + open_ >= SEEN, judged)


def broken_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """src_table, record_id, item_pos, defect: one row per pair with a defective answer."""
    by_lang: dict[str, set[str]] = {}
    for lang, word in common_words(words):
        if lang is not None:
            by_lang.setdefault(lang, set()).add(word)
    common = {k: frozenset(v) for k, v in by_lang.items()}
    looked = stage(look_at_pairs(pairs, common), "looked-at-pairs")
    id_cols = ["src_table", "record_id", "item_pos"]
    known = looked.filter("defect is not null").select(*id_cols, "defect")
    counts = count_wordings(pairs, common)
    # redelivered rows may differ in their answers: each is judged by itself
    asked = looked.filter("defect is null").select(*id_cols, "last", "before", "cut").withColumn("row", F.xxhash64("last", "before", "cut"))
    rows = [*id_cols, "row", "cut"]
    orders = range(len(ORDERS))
    slots = [F.col(c)[i] for c in ("last", "before") for i in orders]
    places = asked.select(*rows, F.posexplode(F.array(*slots)).alias("slot", "key"))
    seen = places.join(counts, "key", "left").groupBy(*rows).agg(
        *[F.max(F.when(F.col("slot") == i, F.struct("mid", "ended", "open"))).alias(f"s{i}") for i in range(len(slots))]
    )
    ends = [_going_on(f"s{i}", 1) for i in orders]
    before = F.coalesce(*[_going_on(f"s{len(ORDERS) + i}", 0) for i in orders], F.lit(False))
    ends_short = F.coalesce(ends[0], F.when(F.col("cut") & before, F.lit(True)), *ends[1:], F.lit(False))
    late = seen.filter(ends_short).select(*id_cols, F.lit("truncated").alias("defect"))
    # repeated rows may differ: the first defect of the order stands
    rank = F.array_position(F.array(*[F.lit(x) for x in DEFECTS]), F.col("defect"))
    return known.unionByName(late).groupBy(*id_cols).agg(F.min_by("defect", rank).alias("defect"))
