"""Template residue, filler and error-page text, by a multi-pattern automaton.

The automaton holds phrases of error pages, filler text and script notices in several languages. A line is
residue if what matches, together with unfilled placeholders, covers a large share of it; a line that only
mentions such a phrase is not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .stats import COMMON

#: share of a line's characters that must be matched
MIN_COVER = 0.33
#: share of a document's characters from which it is excluded as a whole
MAX_COVERAGE = 0.2

# Error, filler and script-required phrases, by language.
PHRASES = """
page not found
page you requested could not be found
may have been moved or deleted
we can’t find what you are looking for
we can't find what you are looking for
check the address or go back to the start page
404 not found
error 404
http error
internal server error
bad gateway
gateway timeout
gateway time-out
service unavailable
the server was unable to complete your request
please try again later
error establishing a database connection
upstream timed out while reading the response
fatal error: uncaught exception
warning: undefined variable
undefined index
stack trace
access denied
you do not have permission to view this resource
you don’t have permission to access
permission denied
403 forbidden
too many requests from your network
seconds and reload
your session has expired
please sign in again to continue
down for scheduled maintenance
we will be back in about
under construction
this content is not available in your region
checking your browser before you continue
scripts and cookies must be on
just a moment
please wait while we
you need to enable javascript to run this app
please enable javascript to view this page
please enable javascript
please turn on javascript
javascript is disabled
javascript is required
this application needs scripts to run
turn them on in your browser settings and reload
your browser does not support scripts or has them blocked
the content cannot be displayed
lorem ipsum dolor sit amet
consectetur adipiscing elit
your text goes here
replace this paragraph with your own words
this is a sample page
edit or delete it, then start writing
add a short introduction here
content coming soon
coming soon
dummy text
placeholder copy
placeholder text
todo: write the description
tbd
asdf
qwerty
test test
page title here
untitled document
[object object]
undefined
null
nan
seite nicht gefunden
die angeforderte seite existiert nicht
bitte prüfen sie die adresse
interner serverfehler
zugriff verweigert
wartungsarbeiten
bitte aktivieren sie javascript
um diese seite anzuzeigen
hier steht ihr text
dies ist ein blindtext und hat keine bedeutung
blindtext
titel hier eingeben
page introuvable
la page demandée n’existe pas ou a été déplacée
la page demandée n'existe pas
erreur interne du serveur
accès refusé
veuillez activer javascript
pour afficher le contenu
texte de remplissage
à modifier avant la mise en ligne
página no encontrada
lo sentimos, la página que busca ya no está disponible
error interno del servidor
acceso denegado
active javascript en su navegador
para ver el contenido
texto de ejemplo
sustituya este párrafo por su contenido
página não encontrada
desculpe, não encontramos esta página
erro interno do servidor
acesso negado
ative o javascript para continuar
texto de exemplo
pagina non trovata
spiacenti, la pagina richiesta non esiste
errore interno del server
accesso negato
per visualizzare il sito occorre attivare javascript
attivare javascript
testo di esempio
страница не найдена
к сожалению, запрошенная страница не существует
внутренняя ошибка сервера
доступ запрещён
доступ запрещен
включите javascript
для просмотра страницы
текст-заполнитель
""".strip().split("\n")

# Phrases that are residue only as a whole title.
TITLES = """
error
oops!
oops
loading
app
loading...
untitled
just a moment
just a moment...
404
500
403
502
503
""".strip().split("\n")

# Words of the usual dummy Latin (the passage that begins "lorem ipsum").
DUMMY_LATIN = """
lorem ipsum dolor amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua enim minim
veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate
velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit
anim laborum vestibulum pellentesque vivamus aliquam suspendisse curabitur
""".split()
#: of these words a line with words of a living language must hold so many different ones
MIN_LATIN_WORDS = 3
#: common words of the languages that are no Latin words too
LIVING = COMMON - set("a ad de e et ex i in la le me ne no non nos o per re se si su tu un ut".split())

PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{0,80}\}\}|\{%[^%\n]{0,80}%\}|<%[^%\n]{0,80}%>|\$\{[^{}\n]{1,60}\}|#\{[^{}\n]{1,60}\}|\{[A-Za-z_]{2,40}\}|\[\[[\w -]{1,40}\]\]"
    r"|@@[\w-]{1,40}@@|%%[\w-]{1,40}%%|__[A-Z][A-Z_]{1,38}__|%\([A-Za-z_]{1,40}\)[sd]|\[INSERT [^\]\n]{1,40}\]|<[A-Za-z_ ]{1,40} goes here>"
    r"|\[(?:[a-z]+_[a-z_]+|title|headline|summary|author|price|name|text|url|image|content)\]"
)
HINTS = ("{", "@@", "%%", "__", "%(", "[", "<%", "goes here>", "${", "#{")


def automaton() -> ahocorasick.Automaton:
    """Phrases, and words of dummy Latin (marked); values are the length and the mark."""
    a = ahocorasick.Automaton()
    for p in DUMMY_LATIN:
        a.add_word(p, (len(p), True))
    for p in PHRASES:
        a.add_word(p, (len(p), False))
    a.make_automaton()
    return a


class Residue:
    """Decides on lines and titles; one per worker."""

    def __init__(self, min_cover: float = MIN_COVER) -> None:
        self.iter = automaton().iter
        self.min_cover = min_cover
        self.titles = set(TITLES)

    def covered(self, line: str) -> int:
        """Characters of the line that phrases, placeholders and dummy Latin cover. Words between dummy Latin words
        belong to it: two such words cover a line without any common word of a living language, three cover from the
        first to the last."""
        low = line.lower()
        n = len(line.strip())
        spans: list[tuple[int, int]] = []
        latin: list[tuple[int, int]] = []
        for end, (k, word) in self.iter(low):
            a, b = end - k + 1, end + 1
            if (a == 0 or not low[a - 1].isalnum()) and (b == len(low) or not low[b].isalnum()):
                (latin if word else spans).append((a, b))
        if latin and (several := len({low[a:b] for a, b in latin})) > 1:
            if not LIVING.intersection(low.split()):
                return n
            if several >= MIN_LATIN_WORDS:
                spans.append((latin[0][0], latin[-1][1]))
        if any(h in line for h in HINTS):
            spans += [m.span() for m in PLACEHOLDER.finditer(line)]
        if not spans:
            return 0
        covered, at = 0, 0
        for a, b in sorted(spans):
            covered += max(0, b - max(a, at))
            at = max(at, b)
        return covered

    def cover(self, line: str) -> float:
        """Share of the line's characters that are covered."""
        n = len(line.strip())
        return min(1.0, self.covered(line) / n) if n else 0.0

    def line(self, line: str | None) -> bool:
        return bool(line) and self.cover(line) >= self.min_cover

    def title(self, title: str | None) -> bool:
        if not title:
            return False
        return title.strip().lower() in self.titles or self.cover(title) >= 0.5


def residue_pages(pages: DataFrame) -> DataFrame:
    """(page_id, residue, coverage) of each row of ``pages`` (page_id, title, paragraphs ARRAY<STRING>).

    ``residue`` is true if the title or at least one line is residue, ``coverage`` the matched share of all
    characters of the lines (0 without lines), by which a page is excluded as a whole (:func:`without_residue`).
    Null titles, paragraphs and lines match nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Residue()
        for batch in batches:
            found, coverage = [], []
            for title, lines in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                sizes = [(len(x.strip()), r.covered(x)) for x in lines or () if x]
                found.append(r.title(title) or any(c >= r.min_cover * n > 0 for n, c in sizes))
                coverage.append(min(1.0, sum(c for _, c in sizes) / max(1, sum(n for n, _ in sizes))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.bool_()), pa.array(coverage, pa.float64())], names=["page_id", "residue", "coverage"])

    return spread(pages.select("page_id", "title", "paragraphs")).mapInArrow(run, "page_id long, residue boolean, coverage double")


def without_residue(pages: DataFrame, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """``page_id`` and ``coverage`` of the pages to keep: matched coverage low relative to the document's length and
    no residue as title."""
    judged = residue_pages(pages)
    return judged.where(F.col("coverage") < max_coverage).select("page_id", "coverage")
