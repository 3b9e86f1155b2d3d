"""Template residue, filler and error pages: a multi-pattern automaton finds known phrases, coverage decides.

One automaton holds the phrases of notices, the single words that mean something else elsewhere, and the beginnings of the words of the
standard filler passage. A field is a notice if phrases cover most of it, whatever its length. Single words ("Gone") cover only beside a
phrase or a status number, or where the record's other field tells no story either. Filler is found sentence by sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsgrid.llm import encoding

#: Share of a field's letters and digits that phrases must cover.
COVERAGE = 0.6
#: Words that a sentence of filler has at least, and the share of them that begin like words of the standard passage.
FILLER_WORDS, FILLER_SHARE = 5, 0.6

# Phrases of error pages, notices, filler and drafts, lower case, in six languages.
PHRASES = """
page not found|the page you asked for could not be found|this page has moved or no longer exists|sorry, this page has moved|sorry, this page|not found|error 404|error 403|error 500|error 502|error 503|error 504|error 410|error 429|http 404|http 403|http 410|http 429|http 500|http 502|http 503|http 504
internal server error|bad gateway|service unavailable|gateway timeout|gateway time-out|too many requests|too many requests from your network|access denied|you do not have permission to view this resource|the requested url was rejected|support id|an unexpected error occurred|something went wrong|try again later|please try again later
upstream request timeout|connection timed out while reading upstream|connection timed out|database connection refused|error establishing a database connection|fatal error|call to undefined function|render_teaser|traceback (most recent call last)|site under maintenance|down for maintenance|this site is under maintenance|we will be back soon|be right back|session expired|your session has expired
seite nicht gefunden|diese seite wurde nicht gefunden|zugriff verweigert|interner serverfehler|dienst nicht verfügbar|ein fehler ist aufgetreten|bitte versuchen sie es später erneut
page introuvable|erreur serveur|accès refusé|accès interdit|une erreur est survenue|réessayez plus tard|site en maintenance|service indisponible
página no encontrada|no se encontró la página solicitada|acceso denegado|error del servidor|se ha producido un error|inténtelo de nuevo más tarde|sitio en mantenimiento|servicio no disponible
página não encontrada|a página não foi encontrada|acesso negado|erro do servidor|erro interno do servidor|ocorreu um erro|tente novamente mais tarde|site em manutenção
страница не найдена|доступ запрещён|доступ запрещен|ошибка сервера|произошла ошибка|попробуйте позже|повторите попытку позже|сервис недоступен|ведутся технические работы
javascript required|this site needs javascript turned on|please enable javascript to view this page|please enable javascript|enable javascript|you need to allow scripts to run this app|your browser is out of date or blocks scripts|please turn on javascript|javascript is disabled|requires javascript
bitte aktivieren sie javascript|javascript aktivieren|veuillez activer javascript pour continuer|veuillez activer javascript|activez javascript|active javascript para ver este contenido|habilite javascript|active o javascript|ative o javascript para continuar|ative o javascript|включите javascript для просмотра|включите javascript
we use cookies|accept all to proceed|accept all cookies|accept cookies|this site uses cookies|wir verwenden cookies|alle akzeptieren|nous utilisons des cookies|tout accepter|usamos cookies|utilizamos cookies|aceptar todo|aceitar todos|мы используем cookies|мы используем файлы cookie|принять все
just a moment|einen moment bitte|un instant|un momento|um momento|один момент|please wait|attention needed|attention required|browser check|checking your browser before access|checking your browser|verify you are human to go on|verify you are human|are you a robot|please stand by|one moment please
headline goes here|title goes here|teaser goes here|text goes here|sample text goes here|sample text|your summary here|your text here|your title here|write summary|this is placeholder copy for the teaser|placeholder copy|dummy content, do not publish|dummy content|dummy text|do not publish|test post please ignore|test post|hello world sample post|hello world|untitled draft|new post (copy)|new post|page title|site name|test test test|test test|xxxxx xxxxx xxx|asdf asdf jkl|lorem ipsum|lorem ipsum dolor sit amet|to be written
beispielbeitrag|beispieltext|platzhaltertext|blindtext|text folgt|titel folgt|überschrift hier|hier steht der text|testbeitrag
texte à venir|titre à venir|texte d'exemple|titre d'exemple|exemple de texte|article de test|contenu à venir
texto de ejemplo|título de ejemplo|texto de relleno|entrada de prueba|contenido pendiente|texto de exemplo|título de exemplo|texto de teste|postagem de teste|conteúdo em breve
пример текста|пример заголовка|текст появится позже|заголовок статьи|тестовая запись|текст-заполнитель|здесь будет текст
"""
#: Single words of such pages that have other uses too.
SINGLE = "gone forbidden undefined null nan none retry oops ray errno keyerror 'teaser' placeholder platzhalter untitled tbd todo asdf xxx xxxxx wartungsarbeiten подождите".split()
#: Fixed value: the standard filler passage.
PASSAGE = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation "
    "ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint "
    "occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum"
)
_NAMES = "title|headline|summary|excerpt|teaser|lead|author_name|author|first_name|last_name|company|date|body|content|text|name|subject|description|category|city|user|email|url|link|image|tag|tags|section|slug|intro|abstract|source"
_FIELD = rf"(?:\w+[._])?(?:{_NAMES})"
#: Unfilled slots of common template languages.
SLOTS = re.compile(
    rf"\{{\{{\s*[\w.|\s]+?\s*\}}\}}|\{{%\s*[\w.\s=\"']+?\s*%\}}|\[%\s*[\w.\s]+?\s*%\]|<%=?\s*[\w.\s()]+?\s*%>|\*\|\s*\w+\s*\|\*|%%?[A-Z][A-Z_]{{2,}}%%?|[$#]\{{\s*[\w.]+\s*\}}|\$\(\s*[\w.]+\s*\)|"
    rf"\[INSERT [^\]]{{1,40}}\]|\[object Object\]|(?<!\w)\[{_FIELD}\]|\{{{_FIELD}\}}|<\w+ goes here>|@@\w+@@|(?<!\w)__[A-Z][A-Z_]+__(?!\w)|(?<![\w%])%[sd](?!\w)|\{{\d\}}|&lt;%.*?%&gt;|(?<!\w)(?:{_NAMES})\s*:\s*(?:undefined|null|nan|none)\b",
    re.I,
)
#: What every slot holds.
_OPENS = re.compile(r"[{<\[%*@_$#]|:\s*(?:undefined|null|nan|none)\b", re.I)
#: Words before a slot by which a report shows or quotes it.
_SHOWN = re.compile(
    r"(?:such as|like|write|writes|writing|written as|named|called|type|types|string|token|tag|marker|syntax|wie|etwa|schreiben|schreibt|comme|écrire|écrivent|como|escribir|escribe|escrever|escreve|пишут|писать|вроде|как)\s+[\"“„«'‘`]?$|[\"“„«‘`]$",
    re.I,
)
_SENTENCE = re.compile(r"(?<=[.?!…])[\"”»’)]*\s+|\s[|·]\s|\n+")
#: Reference numbers that such pages carry: they count neither for nor against.
_REFERENCE = re.compile(r"\b(?:ref|id|node|trace|ray|req|request|incident|code|support id|errno)\b[:\s#]*[0-9a-f]{2,}\b|\b(?=[0-9a-f]*\d)[0-9a-f]{4,}\b|\b\d{3}\b|\((?:ref|id|node|trace|errno)[^)]*\)", re.I)
#: Words that stand beside such notices without being the notice.
_BESIDE = re.compile(r"\b(?:error|erreur|fehler|system|notice|warning|hinweis|aviso|attention|ошибка|site|home|loading|ref|id|node|trace|http|status|code|news|report|update|breaking)\b", re.I)
#: Numbers by which servers tell what went wrong.
_STATUS = re.compile(r"\b(?:4\d\d|5\d\d)\b")
# Short words without which no prose of the six languages goes on for long.
_FUNCTION = frozenset("the and of to for with from on by that der die das und mit von für auf les des une pour avec sur los las una con por para del dos das uma и в на с по для".split())


def automaton() -> ahocorasick.Automaton:
    """The automaton: phrases, single words and the beginnings of filler words, each with its kind ("phrase", "word", "filler") and length."""
    a = ahocorasick.Automaton()
    for beginning in sorted({w[:3] for w in PASSAGE.split() if len(w) >= 3}):
        a.add_word(f" {beginning}", ("filler", 3))
    for word in SINGLE:
        a.add_word(word, ("word", len(word)))
    for phrase in PHRASES.replace("\n", "|").split("|"):
        if phrase:
            a.add_word(phrase, ("phrase", len(phrase)))
    a.make_automaton()
    return a


def _squeeze(text: str) -> str:
    return " ".join(text.split()).replace("’", "'").replace("‘", "'")


def _weight(text: str) -> int:
    return sum(map(str.isalnum, text))


def coverage_of(machine: ahocorasick.Automaton, low: str, alone: bool = False) -> tuple[float, int]:
    """(share of the letters and digits of a squeezed lower-case field that phrases cover, beginnings of filler words in it).

    Reference numbers don't count. Words that stand beside such notices count as covered where a phrase is, and so do single words, or
    with `alone` these without one.
    """
    spans: list[tuple[int, int]] = []
    words: list[tuple[int, int]] = []
    filler = 0
    for end, (kind, n) in machine.iter(f" {low}"):
        start, stop = end - n, end
        if kind == "filler":
            filler += 1
        elif not (start and low[start - 1].isalnum() and low[start].isalnum()) and not (stop < len(low) and low[stop].isalnum() and low[stop - 1].isalnum()):
            (spans if kind == "phrase" else words).append((start, stop))
    if not spans and not (words and (alone or _STATUS.search(low))):
        return 0.0, filler
    rest = _REFERENCE.sub(lambda m: " " * len(m[0]), low)
    marks = bytearray(len(low))
    for start, stop in (*spans, *words, *(m.span() for m in _BESIDE.finditer(rest))):
        marks[start:stop] = b"\1" * (stop - start)
    total = _weight(rest)
    covered = sum(1 for at, ch in enumerate(rest) if marks[at] and ch.isalnum())
    return (covered / total if total else 1.0), filler


def _is_filler(machine: ahocorasick.Automaton, sentence: str) -> bool:
    words = re.findall(r"[^\W\d_]+", sentence)
    if len(words) < FILLER_WORDS or any(w in _FUNCTION for w in words):
        return False
    return sum(1 for _, (kind, _) in machine.iter(f" {' '.join(words)}") if kind == "filler") >= FILLER_SHARE * len(words)


def has_slot(text: str) -> bool:
    """Whether a text holds an unfilled slot that it doesn't show as an example."""
    for m in SLOTS.finditer(text):
        if not _SHOWN.search(text[max(0, m.start() - 24) : m.start()]):
            return True
    return False


def kind_of(machine: ahocorasick.Automaton, text: str | None, coverage: float = COVERAGE, alone: bool = False) -> str | None:
    """`slot`, `filler` or `page` for a field that is or contains residue, else None (also for null and empty ones).

    A slot or a sentence of filler anywhere makes the field residue; notices do where they cover the share `coverage` of the field.
    With `alone` single words are notices too.
    """
    if not text or not text.strip():
        return None
    if _OPENS.search(text) and has_slot(text):
        return "slot"
    low = _squeeze(text).lower()
    covered, filler = coverage_of(machine, low, alone)
    if covered >= coverage:
        return "page"
    if filler >= FILLER_SHARE * FILLER_WORDS and any(_is_filler(machine, p) for p in _SENTENCE.split(low)):
        return "filler"
    return None


def kinds_of(machine: ahocorasick.Automaton, texts: tuple[str | None, ...], coverage: float = COVERAGE) -> list[str | None]:
    """`kind_of` of the fields of one record. Where every other field is residue, empty or null, a single word is a notice."""
    kinds = [kind_of(machine, t, coverage) for t in texts]
    told = [bool(t and t.strip()) and k is None for t, k in zip(texts, kinds)]
    if sum(told) == 1:
        at = told.index(True)
        kinds[at] = kind_of(machine, texts[at], coverage, alone=True)
    return kinds


def label_residue(df: DataFrame, key: str = "id", fields: tuple[str, ...] = ("title", "summary"), coverage: float = COVERAGE) -> DataFrame:
    """(`key`, `field_name`, `kind`): one row per row of `df` and field that is or contains residue.

    `kind` is `slot` (unfilled placeholder), `filler` (pseudo-Latin) or `page` (error page, notice, draft). Null and empty
    fields give no row. Columns besides the key and the fields aren't read.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for b in batches:
            at, names, kinds = [], [], []
            for k, texts in enumerate(zip(*[b.column(j).to_pylist() for j in range(1, len(fields) + 1)])):
                for f, found in zip(fields, kinds_of(machine, texts, coverage)):
                    if found is not None:
                        at.append(k), names.append(f), kinds.append(found)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(kinds, pa.string())], [key, "field_name", "kind"])

    return df.select(key, *fields).mapInArrow(run, f"`{key}` {kind}, field_name string, kind string")


def exclude_residue(df: DataFrame, fields: tuple[str, ...] = ("title", "summary"), coverage: float = COVERAGE) -> DataFrame:
    """The rows of `df`, with all their columns, none of whose fields is or contains residue: one map, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for b in batches:
            texts = zip(*[b.column(b.schema.get_field_index(f)).to_pylist() for f in fields])
            yield b.filter(pa.array([not any(kinds_of(machine, t, coverage)) for t in texts], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def found(articles: DataFrame) -> DataFrame:
    """(`id`) of the articles with residue, each once; null ids are left out."""
    return label_residue(articles.where(F.col("id").isNotNull())).select("id").distinct()
