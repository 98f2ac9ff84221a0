"""Personal information in free text: candidate spans, boosted trees on format and context, placeholders."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import spread
from . import boosting
from .stats import COMMON

KINDS = ("email", "phone", "id_number", "address", "person")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person": "[PERSON]"}
#: characters on each side of a candidate that its features look at
WINDOW = 48


class Span(NamedTuple):
    start: int
    end: int
    kind: str


# --- generators: high recall, spans may overlap ---------------------------------------------------

_AT = r"(?:\s?[@＠]\s?|\s?[(\[]\s?at\s?[)\]]\s?| at )"
_DOT = r"(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?| dot )"
EMAIL = re.compile(rf"(?<![\w.+@/-])[\w+%-]+(?:\.[\w+%-]+)*{_AT}[\w-]+(?:{_DOT}[A-Za-z0-9-]+)+(?![\w@])")
DIGITS = re.compile(
    r"(?<![\w@.,:/+#%-])(?:\+|\()?\d[\d]{0,14}\)?(?:[ .\-/]?\(?\d{1,12}\)?){0,8}"
    r"(?:,? (?:ext|extn|доб|int|poste|x)\.? ?\d{1,5})?(?![\w@%])"
)
CODE = re.compile(r"(?<![\w@.:/+#%-])[A-Z0-9]{1,20}(?:(?: ?№ ?|[ .\-/])[A-Z0-9]{1,12}){0,7}(?![\w@%])")
#: acronyms that announce a number but are not part of it
_ANNOUNCE = {"ID", "DNI", "NIE", "NIF", "CPF", "SSN", "NI", "NHS", "ISBN", "ISSN", "VAT", "IVA", "CF", "GET", "POST", "PUT", "NO", "NR", "N", "TEL", "FAX", "OK", "A", "I", "O", "E", "Y", "IT", "S"}

_CAP = r"[A-ZÀ-ÖØ-ÞА-ЯЁ]"
_LOW = r"[a-zß-öø-ÿа-яё]"
_EN = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Way|Close|Court|Ct|Place|Pl|Terrace|Crescent|Square|Sq|Boulevard|Blvd|Grove|Hill|Row|Walk|Gardens|Mews|Parade"
_NR = r"\d{1,4}(?: ?[a-zа-г](?!\w))?(?: (?:bis|ter)\b)?"
_ROMANCE = r"(?:(?:d[eiao]s?|del|della|dei|delle|degli|dal|du|des|de la|de las|de los|de el|da|do|das|dos|de l’|de l'|d’|d'|dell’|dell') ?)?"
_AFTER = r"(?:,? (?:n\.?[ºo°]?|nº|n°|num\.|núm\.|д\.|дом|no\.) ?|, ?| )"
ADDRESSES = [
    re.compile(rf"(?<![\w-]){_NR},? (?:{_CAP}[\w’'-]+ ){{1,4}}(?:{_EN})\b(?!\w)"),
    re.compile(rf"(?<![\w-]){_NR},? (?:rue|avenue|av\.|allée|impasse|boulevard|bd|place|chemin|quai|cours|route|passage|square) {_ROMANCE}{_CAP}[\w’'-]+(?: {_CAP}[\w’'-]+)*"),
    re.compile(rf"(?<!\w){_CAP}[\w-]*(?:straße|strasse|str\.|gasse|weg|allee|platz|ring|damm|ufer|steig|chaussee|wall|graben) {_NR}(?!\w)"),
    re.compile(rf"(?<!\w)(?:{_CAP}[\w-]+ )?(?:Straße|Strasse|Str\.|Allee|Platz|Weg|Gasse|Ring) {_NR}(?!\w)"),
    re.compile(
        rf"(?<!\w)(?:Calle|C/|Avenida|Avda\.|Av\.|Plaza|Pza\.|Paseo|Camino|Travesía|Carrera|Ronda|Rua|R\.|Travessa|Largo|Praça|Estrada|Alameda|Via|Viale|Vicolo|Corso|Piazza|Piazzale|Strada|Borgo)"
        rf" {_ROMANCE}{_CAP}[\w’'-]+(?: {_CAP}[\w’'-]+)*{_AFTER}{_NR}(?!\w)"
    ),
    re.compile(rf"(?<!\w)(?:улица|ул\.|проспект|просп\.|пр\.|пр-т|переулок|пер\.|набережная|наб\.|шоссе|бульвар|бул\.|площадь|пл\.|проезд|тупик) {_CAP}[\w-]+(?: {_CAP}[\w-]+)*{_AFTER}{_NR}(?!\w)"),
    re.compile(rf"(?<!\w){_CAP}[\w-]+ (?:улица|проспект|переулок|набережная|шоссе|бульвар|площадь|проезд){_AFTER}{_NR}(?!\w)"),
]
_HOUSE = re.compile(r"(?<![\w.:-])\d{1,4}(?!\d)")
_STREET_BEFORE = re.compile(
    r"stra(?:ß|ss)e|str\.|gasse|weg|allee|platz|ring|damm|ufer|steig|chaussee|wall|graben|Stra(?:ß|ss)e|Str\.|Allee|Platz|Weg|Gasse"
    r"|Calle|C/|Av|Plaza|Pza|Paseo|Camino|Traves|Carrera|Ronda|Rua|R\.|Largo|Praça|Estrada|Alameda|Via|Viale|Vicolo|Corso|Piazza|Strada|Borgo"
    r"|ул\.|улиц|просп|пр\.|пр-т|переул|пер\.|набер|наб\.|шосс|бульв|бул\.|площ|пл\.|проезд|тупик"
)
#: characters before a house number in which its street is looked for
STREET_SPAN = 72
_AT_SIGN = re.compile(r"[@＠]|[(\[]\s?at\s?[)\]]| at (?=[\w-]+(?:\.\w| dot |\s?[(\[]\s?dot))")
#: characters around an at sign that an address of e-mail may take
MAIL_SPAN = 100
_NAME = rf"(?:{_CAP}{_LOW}+(?:[’'-]{_CAP}?{_LOW}+)*|{_CAP}{{2,}}(?:-{_CAP}{{2,}})*|{_CAP}\.)"
RUN = re.compile(rf"(?<![\w@.’'-]){_NAME}(?:,? {_NAME}){{1,7}}(?![\w@])")
_PART = re.compile(_NAME)

# Titles, which are not part of a name.
TITLES = frozenset("mr mrs ms miss dr prof sir madam herr frau fräulein dr. prof. mr. mrs. ms. m. mme mlle monsieur madame señor señora sr. sra. don doña senhor senhora dom dona signor signora sig. dott. avv. г-н г-жа господин госпожа".split())
# Frequent given names of the languages covered, in no order of importance.
GIVEN = frozenset("""
alice anna arthur charles dominic edith edwin ella emma frank george grace harold helen henry irene jack james jane joan john joseph kate kofi laura louis lucy margaret
mark martin mary mei michael nora oliver paul peter priya richard robert ruth samuel sarah simon susan tariq thomas walter william
annika björn dieter greta hans heike jonas jürgen karl käthe klaus lena lukas moritz monika petra sabine stefan ursula ute werner wolfgang
anaïs antoine benoît camille claire élodie gérard hélène isabelle jean julien luc margaux mathieu michel nathalie philippe pierre solène thierry
álvaro antonio carmen diego esteban iñigo javier joaquín josé juan lucía luis manuel maría miguel nieves pablo pilar ramón rocío teresa
beatriz conceição duarte fernanda inês joão leonor nuno paulo pedro rui tiago vasco
alessandro chiara elisa francesca giovanni giulia lorenzo luca marco marta matteo niccolò ornella paolo pietro renzo silvana
алексей анна артём вера галина дмитрий иван игорь ирина марина михаил наталья олег ольга павел светлана сергей степан татьяна юрий
""".split())  # fmt: skip

# Words before or after a candidate, by what they announce.
CUES = {
    "phone": "call|phone|telephone|tel|tél|mobile|cell|fax|number is|ring|under|unter|erreichbar|anruf|telefon|appel|téléphone|llame|teléfono|ligue|ligar|telefone|chiamar|telefono|звоните|тел|телефон|по номеру|en el",
    "id": "social security|security no|security number|passport|tax id|tax no|licen[cs]e|national id|insurance|identity|id no|id:|ausweis|steuer|versicherungs|führerschein|reisepass|carte d.identité|sécurité sociale|passeport|permis|fiscal|dni|nie|nif|seguridad social|pasaporte|permiso|carné|identidade|contribuinte|passaporte|cpf|carta di identità|patente|codice fiscale|tessera|паспорт|документа|снилс|инн|удостоверени|полис",
    "other": "order|invoice|tracking|isbn|issn|version|build|checksum|ratio|position|room|chapter|pages?|port|ticket|bestell|rechnungs?nr|rechnung nr|commande|facture|pedido|factura|fatura|encomenda|ordine|fattura|spedizione|заказ|счёт|код отправления|measured|get http|article no|serial|sku|ref|batch|model",
    "mail": "write|mail|contact|e-mail|reply|report|schreib|kontakt|rückfragen|écri|signalez|escriba|avise|correo|escreva|avise|scriv|segnal|пишите|почт|webmaster",
    "person": "according to|contact ?:?|signed,?|ask for|we met|name is|applicant|regards,?|sincerely,?|ansprechpartner(?:in)? ist|ansprechpartner:?|grüßen,?|laut|selon|cordialement,?|je m.appelle|según|atentamente,?|pregunte por|contacto:?|me llamo|segundo|contato:?|cumprimentos,?|chamo|secondo|saluti,?|contatto:?|mi chiamo|сообщила?|уважением,?|контакт:?|зовут|спросить|herr|frau|mr|mrs|ms|dr|prof|mme|señora?|sra?|sig|by|author:?|from",
    "place": "lake|mount|river|island|port|cape|bay|valley|fort|the|of|in|near|at|to",
}
_CUE = {k: re.compile(rf"(?:^|\W)(?:{v})[\s:.,#°ºn]*(?:(?:no|nr|n|es|é|ist|is|le|el|il|al|o|a|the|под|в|au|para|an)[\s:.°º]*){{0,2}}$", re.I) for k, v in CUES.items()}
_NEAR = {k: re.compile(rf"(?:^|\W)(?:{v})", re.I) for k, v in CUES.items()}
_ORG = re.compile(rf"\b(?:{_EN}|Theatre|Theater|Museum|Quartet|Orchestra|Company|University|Institute|Library|Society|Club|Market|Shop|Gazette|Bank|Hotel|Church|School|Park|Bridge|Station|Mount|Lake|River|Island|Bend|North|South|East|West|Old|New|Version|Chapter|Room|Invoice|Order|Tracking|Build|Ratio|Tax|National|Driver|Webmaster)\b", re.I)
_AFTER_NAME = re.compile(r"^(?:,? (?:told|said|says|reads|writes|and I|wohnt|sagte|lives|passport|outside|tel|tél|тел|phone|rien|todavía|nada|nulla|решения|erreichbar|en el|the |born)|[,;:.]|\s*$|\n)", re.I)
_EXT = re.compile(r"(?:ext|extn|доб|int|poste|x)\.? ?\d", re.I)


def candidates(text: str) -> list[Span]:
    """Spans that may be personal information; the kind of a number is still open between phone and id."""
    out: list[Span] = []
    for m in _AT_SIGN.finditer(text):
        e = EMAIL.search(text, max(0, m.start() - MAIL_SPAN), m.end() + MAIL_SPAN)
        while e and e.end() <= m.start():
            e = EMAIL.search(text, e.end(), m.end() + MAIL_SPAN)
        if e and e.start() < m.start():
            out.append(Span(e.start(), e.end(), "email"))
    for m in DIGITS.finditer(text):
        s = m.group()
        if sum(map(str.isdigit, s)) >= 7:
            out.append(Span(m.start(), m.end(), "phone"))
            if e := _EXT.search(s):
                out.append(Span(m.start(), m.start() + len(s[: e.start()].rstrip(" ,")), "phone"))
    for m in CODE.finditer(text):
        s, at = m.group(), m.start()
        digits = sum(map(str.isdigit, s))
        if digits < 4 or len(s) < 6:
            continue
        parts = [(p.start(), p.group()) for p in re.finditer(r"[A-Z0-9]+", s)]
        heads = [0]
        for i, (_, p) in enumerate(parts[:-1]):
            if p.isdigit():
                break
            heads.append(i + 1)
        tails = [len(s)]
        for i in range(len(parts) - 1, 0, -1):
            if parts[i][1].isdigit() or i == len(parts) - 1 and any(map(str.isdigit, parts[i][1])):
                break
            tails.append(parts[i - 1][0] + len(parts[i - 1][1]))
        for h in heads:
            for t in tails:
                a = parts[h][0]
                if t - a >= 6 and parts[h][1] not in _ANNOUNCE:
                    out.append(Span(at + a, at + t, "id_number"))
    for m in _HOUSE.finditer(text):
        at = m.start()
        for r in ADDRESSES[:2]:
            if e := r.match(text, at):
                out.append(Span(at, e.end(), "address"))
        before = max(0, at - STREET_SPAN)
        if _STREET_BEFORE.search(text, before, at):
            for r in ADDRESSES[2:]:
                out += [Span(e.start(), e.end(), "address") for e in r.finditer(text, before, m.end() + 5) if e.end() >= m.end()]
    for m in RUN.finditer(text):
        parts = [(p.start(), p.end(), p.group()) for p in _PART.finditer(m.group())]
        n, at = len(parts), m.start()
        ok = [p[2].lower() not in TITLES and p[2].lower() not in COMMON or len(p[2]) == 2 for p in parts]
        for i in range(n - 1):
            for j in range(i + 2, min(n, i + 3) + 1):
                if all(ok[i:j]) and any(len(p[2]) > 2 for p in parts[i:j]):
                    out.append(Span(at + parts[i][0], at + parts[j - 1][1], "person"))
    return list(dict.fromkeys(out))


# --- features ---------------------------------------------------------------------------------------

N_FEATURES = 36


def features(text: str, s: Span) -> list[int]:
    """Small non-negative integers on the format and the context of a candidate."""
    v = text[s.start : s.end]
    left, right = text[max(0, s.start - WINDOW) : s.start], text[s.end : s.end + WINDOW]
    left = left[left.rfind("\n") + 1 :]
    line = right.split("\n", 1)[0]
    digits = sum(map(str.isdigit, v))
    f = [
        min(15, len(v) // 3), digits, sum(map(str.isalpha, v)), v.count(" "), v.count("-"), v.count("."), v.count("/"),
        v.count("(") + v.count(")"), v[0] == "+", v[0] == "0", v[0] == "(", "№" in v, v.count(","),
        v[0].isalpha(), v[-1].isalpha(), v.isupper(),
    ]
    kind = s.kind
    if kind in ("phone", "id_number"):
        groups = re.findall(r"\w+", v)
        sizes = [len(g) for g in groups]
        f += [
            len(groups), max(sizes), min(sizes), sizes[0], sizes[-1],
            bool(_CUE["phone"].search(left)), bool(_CUE["id"].search(left)), bool(_CUE["other"].search(left)),
            bool(_NEAR["phone"].search(left)), bool(_NEAR["id"].search(left)), bool(_NEAR["other"].search(left)),
            bool(_EXT.search(v)), bool(re.match(r"(?:19|20)\d\d[-./](?:0\d|1[0-2])", v)), bool(re.search(r"\d\d:\d\d", right[:8])),
            bool(re.match(r",? ?(?:ext|доб)", line)), not left.strip(), bool(re.match(r"[^\w]{0,3}$", line)), v[:3] in ("978", "979"),
            bool(re.search(r"[A-Z]{2,}[ ]?$|\d ?$", left)), bool(re.match(r" ?[\d№]", right)),
        ]
    elif kind == "email":
        f += [
            "@" in v or "＠" in v, "(at)" in v.replace(" ", "") or "[at]" in v.replace(" ", ""), " at " in v, "dot" in v,
            bool(_NEAR["mail"].search(left)), len(re.split(r"[.]|dot", v)), len(re.findall(r"[A-Za-z]+", v)[-1]) if re.search(r"[A-Za-z]", v) else 0,
            "http" in left, left[-1:] in "/:=", bool(re.search(r"\d", v)), bool(re.search(r" (?:dot|at) ", v)), v.count("\n"),
        ] + [0] * 8
    elif kind == "address":
        f += [
            v[0].isdigit(), v[-1].isdigit() or v[-1].islower(), bool(re.search(rf"\b(?:{_EN})$", v)), bool(re.search(r"(?i)rue|avenue|allée|place|chemin|impasse|boulevard|quai", v)),
            bool(re.search(r"stra(?:ß|ss)e|str\.|gasse|weg|allee|platz", v)), bool(re.search(r"(?:Calle|C/|Plaza|Paseo|Camino|Rua|Travessa|Largo|Avenida|Via|Viale|Vicolo|Corso|Piazza)", v)),
            bool(re.search(r"[а-я]", v)), len(v.split()), bool(re.search(r"(?i)(?:at|to|in|outside|der|au|en|na|ora in|lives at|address|адресу|auf|is|im|am)[\s:]*$", left)),
            bool(_NEAR["other"].search(left)), bool(re.search(r"\d[.,:]?\d* ?$", left)), bool(_ORG.match(line.strip() or "-")), bool(re.match(rf" {_CAP}", right)),
        ] + [0] * 7
    else:
        parts = [p.lower() for p in _PART.findall(v)]
        given = [p in GIVEN for p in parts]
        word = re.search(r"([\w’'-]+)\W*$", left)
        prev = word.group(1) if word else ""
        f += [
            len(parts), given[0], given[-1], sum(given), len(parts[0]) == 2, any(len(p) == 2 for p in parts[1:]), "," in v,
            bool(_CUE["person"].search(left)), bool(_CUE["place"].search(left)), bool(_ORG.search(v)), bool(_ORG.match(line.strip() or "-")),
            bool(_AFTER_NAME.match(right)), bool(re.search(r"(?:^|[.!?…:»\n]\s*)$", left)), bool(prev) and prev[0].isupper() and prev.lower() not in TITLES,
            bool(re.match(rf",? {_CAP}{_LOW}", right)), bool(re.match(rf",? (?:{_CAP}\.|{_CAP}{_LOW}+)", right)) and bool(re.match(r",? ([\w.]+)", right)) and re.match(r",? ([\w.]+)", right).group(1).lower() in GIVEN,
            prev.lower() in GIVEN, sum(len(p) for p in parts) // 3, bool(re.search(r"(?:ов|ев|ин|ова|ева|ина|ский|ская)$", parts[-1]) or re.search(r"(?:ов|ев|ин|ова|ева|ина|ский|ская)$", parts[0])),
            bool(re.search(rf"{_CAP}\. ?$", left)),
        ]
    return [min(boosting.BINS - 1, int(x)) for x in f]


# --- model --------------------------------------------------------------------------------------------


class Model:
    """A booster and a threshold for each kind, trained on generated labelled texts (see ``pii_training``)."""

    def __init__(self, boosters: dict[str, boosting.Booster], thresholds: dict[str, float]) -> None:
        self.boosters, self.thresholds = boosters, thresholds

    def find(self, texts: list[str]) -> list[list[Span]]:
        """The spans to redact in each text, in order and without overlaps."""
        spans = [candidates(t) if t else [] for t in texts]
        scored: list[list[tuple[float, Span]]] = [[] for _ in texts]
        for kind, booster in self.boosters.items():
            # a number is judged as a phone and as an id, whichever generator proposed it
            both = kind in ("phone", "id_number")
            rows = [(i, s) for i, found in enumerate(spans) for s in found if s.kind == kind or both and s.kind in ("phone", "id_number")]
            if rows:
                rows = list(dict.fromkeys((i, Span(s.start, s.end, kind)) for i, s in rows))
                p = booster.score(np.array([features(texts[i], s) for i, s in rows]))
                limit = self.thresholds[kind]
                for (i, s), x in zip(rows, p, strict=True):
                    if x >= limit:
                        scored[i].append((float(x), s))
        return [_resolve(x) for x in scored]


def _resolve(scored: list[tuple[float, Span]]) -> list[Span]:
    """Best first, longer first among equals; what overlaps a kept span goes. Addresses and mail win over names."""
    order = {"email": 0, "address": 1, "phone": 2, "id_number": 2, "person": 3}
    kept: list[Span] = []
    for _, s in sorted(scored, key=lambda x: (order[x[1].kind], -round(x[0], 2), x[1].start - x[1].end)):
        if all(s.end <= k.start or s.start >= k.end for k in kept):
            kept.append(s)
    return sorted(kept)


@lru_cache(maxsize=1)
def default_model() -> Model:
    """Trained once per process; the training texts, their number and the seed are fixed."""
    from . import pii_training

    return pii_training.train()


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its kind's placeholder; null stays null."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s in spans:
        out += [text[at : s.start], PLACEHOLDERS[s.kind]]
        at = s.end
    return "".join([*out, text[at:]])


def _mapped(docs: DataFrame, key: str, text: str, schema: str, emit, model: Model | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for at in range(0, len(texts), 500):
                part = [t or "" for t in texts[at : at + 500]]
                yield emit(keys.slice(at, 500), texts[at : at + 500], part, m.find(part))

    return spread(docs.select(key, text)).mapInArrow(run, schema)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(key, kind, value) of each different item of each row. Null and empty texts have none."""

    def emit(keys, _texts, texts, found):  # noqa: ANN001, ANN202
        k, rows = [], []
        for i, spans in enumerate(found):
            items = list(dict.fromkeys((s.kind, texts[i][s.start : s.end]) for s in spans))
            k += [i] * len(items)
            rows += items
        kinds, values = pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())
        return pa.RecordBatch.from_arrays([keys.take(pa.array(k, pa.int32())), kinds, values], names=[key, "kind", "value"])

    return _mapped(docs, key, text, f"`{key}` {docs.schema[key].dataType.simpleString()}, kind string, value string", emit, model)


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(key, text) with personal information replaced by typed placeholders; the rest of a text is unchanged."""

    def emit(keys, raw, _texts, found):  # noqa: ANN001, ANN202
        out = pa.array([redact(t, s) for t, s in zip(raw, found, strict=True)], pa.string())
        return pa.RecordBatch.from_arrays([keys, out], names=[key, text])

    return _mapped(docs, key, text, f"`{key}` {docs.schema[key].dataType.simpleString()}, `{text}` string", emit, model)
