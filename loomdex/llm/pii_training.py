"""Generated labelled texts on which the redaction model is trained.

Sentences around made-up values, in the languages covered, with the usual ways of writing each kind of
item and with numbers, places and organisations that look alike but are no cases.
"""

from __future__ import annotations

import random

import numpy as np

from . import boosting
from .pii import GIVEN, KINDS, N_FEATURES, Model, Span, candidates, features

TEXTS = 9_000
SEED = 17

_SYL = "an ber cor dal el fen gar hol in jor kel lam mor nel or pas quin ros sel tor ul ver win yor zan".split()
_END = "son berg er ell ini ez eau ard mann sen well ton field ova ic o i a hart wick dale by".split()
_RU = "Арс Бор Вол Гор Дол Жар Зим Кар Лоп Мор Ник Орл Пет Род Сол Тих".split()
_RU_END = "ов ев ин овский ова ева ина енко".split()
_GIVEN = sorted(GIVEN)


class _Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def d(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def up(self, n: int) -> str:
        return "".join(self.r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(n))

    def word(self) -> str:
        return "".join(self.r.choice(_SYL) for _ in range(self.r.choice((2, 2, 3))))

    def family(self, russian: bool) -> str:
        if russian:
            return self.r.choice(_RU) + self.r.choice(("", "ом", "ан", "ил")) + self.r.choice(_RU_END)
        f = (self.r.choice(_SYL) + self.r.choice(("", self.r.choice(_SYL))) + self.r.choice(_END)).capitalize()
        return f"{f}-{self.family(False)}" if self.r.random() < 0.06 else f

    def person(self) -> str:
        r = self.r
        g = r.choice(_GIVEN) if r.random() < 0.92 else self.word()
        russian = "а" <= g[0] <= "я" or g[0] == "ё"
        g, f = g.capitalize(), self.family(russian)
        x = r.random()
        if x < 0.55:
            name = f"{g} {f}"
        elif x < 0.65:
            name = f"{g} {self.up(1)}. {f}"
        elif x < 0.78:
            name = f"{g[0]}. {f}"
        elif x < 0.84:
            name = f"{f} {g}" if russian else f"{g} {r.choice(_GIVEN).capitalize() if r.random() < 0.9 else g} {f}"
        elif x < 0.87:
            name = f"{f} {g}"
        else:
            name = f"{f}, {g}"
        return name.upper() if r.random() < 0.07 else name

    def email(self) -> str:
        r = self.r
        local = r.choice((self.word(), f"{self.word()}.{self.word()}", f"{self.word()}_{self.word()}", f"{self.word()}{self.d(2)}", "info", "office", "no-reply-" + self.d(2), self.word() + "+" + self.word()))
        labels = [r.choice(("mail", "post", "web"))] * (r.random() < 0.3) + [self.word() + self.word(), r.choice(("com", "org", "net", "de", "example", "test", "co.example", "org.test", "invalid", "info"))]
        domain = ".".join(labels)
        x = r.random()
        if x < 0.66:
            s = f"{local}@{domain}"
            return s.upper() if r.random() < 0.08 else s
        at = r.choice(("＠", " @ ", "@ ", "(at)", " (at) ", " [at] ", " at ", "[at]"))
        if at in ("＠", " @ ", "@ ") or r.random() < 0.2 and at != " at ":
            return f"{local}{at}{domain}"
        return local + at + domain.replace(".", r.choice((" dot ", "(dot)", " (dot) ", " [dot] ")))

    def phone(self) -> str:
        d, r = self.d, self.r
        s = r.choice((
            lambda: f"+1 {d(3)} {d(3)} {d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"1-{d(3)}-{d(3)}-{d(4)}",
            lambda: f"0{d(2)} {d(4)} {d(4)}", lambda: f"0{d(4)} {d(6)}", lambda: f"+44 {d(4)} {d(3)} {d(3)}", lambda: f"+39 0{d(1)} {d(3)} {d(4)}", lambda: f"0{d(1)} {d(4)} {d(3)}", lambda: f"0{d(1)}/{d(7)}",
            lambda: f"0049 {d(2)} {d(5)} {d(3)}", lambda: f"+49 {d(2)} {d(8)}", lambda: f"(0{d(2)}) {d(5)} {d(3)}", lambda: f"0{d(3)} {d(7)}", lambda: f"0{d(2)} {d(5)} {d(3)}",
            lambda: f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"+33 (0){d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"0{d(9)}",
            lambda: f"+34 {d(3)} {d(3)} {d(3)}", lambda: f"{d(3)} {d(2)} {d(2)} {d(2)}", lambda: f"9{d(2)}-{d(3)}-{d(3)}", lambda: f"+55 {d(2)} {d(4)} {d(4)}", lambda: f"({d(2)}) {d(4)}-{d(4)}", lambda: f"+351 {d(3)} {d(3)} {d(3)}",
            lambda: f"+7 {d(3)} {d(3)}-{d(2)}-{d(2)}", lambda: f"8 ({d(3)}) {d(3)}-{d(2)}-{d(2)}", lambda: f"8{d(10)}",
        ))()
        return f"{s} ext. {d(3)}" if r.random() < 0.12 else s

    def id_number(self) -> str:
        d, u, r = self.d, self.up, self.r
        return r.choice((
            lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{d(3)} {d(2)} {d(4)}", lambda: f"{d(2)}-{d(6)}-{u(1)}", lambda: f"{u(1)}{d(8)}", lambda: f"{u(2)} {d(2)} {d(2)} {d(2)} {u(1)}",
            lambda: f"{d(2)}{u(2)}{d(5)}", lambda: f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", lambda: f"{d(8)}-{u(1)}", lambda: f"{d(8)}{u(1)}", lambda: f"{d(2)}.{d(3)}.{d(3)}-{u(1)}", lambda: f"{u(1)}{d(7)}{u(1)}",
            lambda: f"{u(1)}{d(2)}{u(2)}{d(4)}", lambda: f"{d(2)} {d(3)} {d(3)} {d(3)}", lambda: f"{d(3)}/{d(3)}/{d(5)}", lambda: f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", lambda: f"{d(8)} {d(1)} {u(2)}{d(1)}",
            lambda: f"{u(6)}{d(2)}{u(1)}{d(2)}{u(1)}{d(3)}{u(1)}", lambda: f"{d(4)} № {d(6)}", lambda: f"{d(2)} {d(2)} № {d(6)}", lambda: f"{d(2)} {d(2)} {d(6)}", lambda: f"{d(3)}-{d(3)}-{d(3)} {d(2)}", lambda: f"{d(9)}", lambda: f"{d(11)}",
        ))()

    def address(self) -> str:
        r = self.r
        n = str(r.randint(1, 250)) + (r.choice("abc") if r.random() < 0.3 else "")
        one = lambda: self.word().capitalize()
        w = lambda: f"{one()} {one()}" if r.random() < 0.3 else one()
        return r.choice((
            lambda: f"{n} {w()} {r.choice(('Street', 'St', 'Road', 'Rd', 'Avenue', 'Ave', 'Lane', 'Ln', 'Drive', 'Way', 'Close', 'Court'))}",
            lambda: f"{n} {r.choice(('Old', 'North', 'Upper', 'Mill', 'Chapel'))} {w()} {r.choice(('Street', 'St', 'Road', 'Rd', 'Avenue', 'Lane', 'Drive', 'Way', 'Close'))}",
            lambda: f"{one()}{r.choice(('straße', 'str.', 'gasse', 'weg', 'allee', 'platz'))} {n}",
            lambda: f"{n}{r.choice(('', ',', ' bis'))} {r.choice(('rue', 'avenue', 'place', 'chemin', 'allée'))} {r.choice(('des ', 'du ', 'de la ', ''))}{w()}",
            lambda: f"{r.choice(('Calle', 'C/', 'Plaza', 'Paseo', 'Camino'))} {r.choice(('de la ', 'de los ', 'del ', 'de las '))}{w()}{r.choice((' ', ', ', ', n.º '))}{n}",
            lambda: f"{r.choice(('Rua', 'Avenida', 'Travessa', 'Largo'))} {r.choice(('da ', 'do ', 'dos '))}{w()}{r.choice((' ', ', ', ', n.º '))}{n}",
            lambda: f"{r.choice(('Via', 'Viale', 'Vicolo', 'Corso'))} {r.choice(('dei ', 'del ', 'della ', ''))}{w()}{r.choice((' ', ', ', ' n. '))}{n}",
            lambda: f"{r.choice(('улица', 'ул.', 'переулок', 'проспект', 'пер.', 'пр.'))} {r.choice(_RU)}{r.choice(('овая', 'ная', 'ский'))}{r.choice((', ', ', д. ', ', дом '))}{n}",
        ))()

    def other_number(self) -> str:
        d, u, r = self.d, self.up, self.r
        return r.choice((
            lambda: f"{r.choice(('Order no.', 'Order number', 'Bestellung Nr.', 'Commande n°', 'Pedido n.º', 'Ordine n.', 'Заказ №'))} {d(3)}-{d(3)}-{d(3)}", lambda: f"{r.choice(('Invoice', 'Rechnung Nr.', 'Facture', 'Factura', 'Fattura', 'Счёт'))} {d(6)}",
            lambda: f"{r.choice(('Tracking code', 'Tracking number', 'Tracking no.'))} {u(2)} {d(3)} {d(3)} {d(2)}", lambda: f"ISBN 979-{d(1)}-{d(3)}-{d(3)}-{d(1)}", lambda: f"ISBN 978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: f"checksum {d(12)}",
            lambda: f"version {d(1)}.{d(2)}.{d(3)}.{d(1)}", lambda: f"build {d(1)}.{d(1)}.{d(4)}", lambda: f"measured at 20{r.randint(10, 26)}-0{r.randint(1, 9)}-1{d(1)} 1{d(1)}:2{d(1)}:3{d(1)}", lambda: f"position {d(2)}.{d(3)}, {d(1)}.{d(3)}",
            lambda: f"pages {d(3)}–{d(3)}", lambda: f"ratio {d(3)}:{d(3)}", lambda: f"Ticket {u(3)}-{d(5)}", lambda: f"article no. {d(4)}-{d(4)}", lambda: f"{d(4)} {d(4)} {d(4)} rows", lambda: f"serial {u(2)}{d(7)}", lambda: f"{d(7)} visitors", lambda: f"batch {d(8)}",
        ))()

    def place(self) -> str:
        r = self.r
        w = lambda: self.word().capitalize()
        return r.choice((
            lambda: f"Lake {w()} and Mount {w()}", lambda: f"The {w()} Street Theatre", lambda: f"the {w()} Quartet", lambda: f"The Old {w()} Road", lambda: f"{w()} Market Hall", lambda: f"the {w()} {w()} Museum", lambda: f"Port {w()}",
            lambda: f"{w()} Forum", lambda: f"das {w()} Museum", lambda: f"Der {w()} Verein", lambda: f"North {w()} Bridge", lambda: f"{w()} Gazette", lambda: f"the University of {w()}", lambda: f"{w()} & {w()} Ltd",
        ))()


#: sentences with slots; no slot stands for a case of another kind
_FRAMES = """
Please call {phone} after lunch and ask for {person}.
You can reach us by phone: {phone}.
tel. {phone}
phone {phone} / mail {email}
Contact: {person}, {phone}, {email}
Contact: {person}, tel. {phone}
my new number is {phone} thanks
Our office can be reached under {phone} on weekdays.
Questions go to {email} or {phone}.
Write to {email} for details; {person} answers every message.
Send a report to {email}.
Reply to {email}
Webmaster: {email} – address {address}
According to {person}, the work will stop.
{person} told the reporter that nothing was decided.
My name is {person} and I live here.
Signed, {person}
Kind regards, {person}
We met {person} outside {address} and talked.
The shop has moved to {address} in Marburg.
Send the parcel to {address}, third floor.
Applicant {person}, passport no. {id_number}, lives at {address}.
Her social security number is {id_number}, and she wants it removed.
Tax ID {id_number} is needed on each bill.
National ID: {id_number}
Driver licence {id_number} was found; the owner may call {phone}.
Insurance number {id_number}
Ansprechpartner ist {person}, erreichbar unter {phone}.
Fragen bitte an {email} oder unter {phone}.
Frau {person} wohnt seit Jahren in der {address}.
Das Büro liegt jetzt in der {address}.
Steuernummer {id_number}, bitte angeben.
Ausweisnummer: {id_number}
Mit freundlichen Grüßen, {person}
Wer etwas weiß, schreibt an {email}.
{person} sagte der Zeitung, es sei offen.
Écrivez à {email} ou appelez le {phone}.
Contact : {person}, tél. {phone}
Selon {person}, rien n’est décidé.
Carte d’identité n° {id_number}, délivrée il y a longtemps.
Numéro de sécurité sociale : {id_number}
Le bureau se trouve au {address}.
Cordialement, {person}
Escriba a {email} o llame al {phone}.
Contacto: {person}, tel. {phone}
Según {person}, no hay nada.
Mi DNI es {id_number} y quiero cambiarlo.
La oficina está en {address}.
Atentamente, {person}
Pregunte por {person} en el {phone} por la tarde.
Escreva para {email} ou ligue para {phone}.
Contato: {person}, tel. {phone}
Segundo {person}, nada está certo.
O meu número de identidade é {id_number}.
A oficina fica na {address}.
Scrivere a {email} o chiamare il {phone}.
Contatto: {person}, tel. {phone}
Secondo {person}, nulla è certo.
Codice fiscale {id_number}
La bottega è in {address}.
Cordiali saluti, {person}
Пишите на {email} или звоните {phone}.
Контакт: {person}, тел. {phone}
Как сообщил {person}, решения нет.
Паспорт {id_number} найден в парке.
Номер документа: {id_number}
Офис находится по адресу {address}.
С уважением, {person}
{other_number} was sent.
{other_number}
The file shows {other_number} today.
{place} was closed for 300 hours.
{place} opens again in May.
A walk from {place} to the coast takes an hour.
The town library and the night editor looked at 450 maps.
Die kleine Werkstatt am Markt prüfte 300 Karten. Das Museum bleibt zu.
Follow @{word} or open /users/{word}@latest in the list.
git@ stands before every remote.
The council met at noon. Nothing else happened.
Elsewhere, the old mill was sold near Karlin.
La rédaction a réparé la salle. Le musée reste fermé.
El museo abrió la sala. La biblioteca cerró.
Un anno dopo, il museo ha aperto. La scuola resta chiusa.
Небольшой музей открыл зал. Старый архив закрыт.
""".strip().split("\n")


def labelled_texts(n: int = TEXTS, seed: int = SEED) -> list[tuple[str, set[Span]]]:
    """Texts of one to four sentences with the spans that are cases."""
    m = _Maker(seed)
    out = []
    for _ in range(n):
        text, spans = "", set()
        for frame in (m.r.choice(_FRAMES) for _ in range(m.r.randint(1, 4))):
            if text:
                text += m.r.choice((" ", " ", "\n", "  "))
            at = 0
            while (a := frame.find("{", at)) >= 0:
                b = frame.index("}", a)
                slot = frame[a + 1 : b]
                text += frame[at:a]
                value = getattr(m, slot)()
                if slot in KINDS:
                    spans.add(Span(len(text), len(text) + len(value), slot))
                text += value
                at = b + 1
            text += frame[at:]
        out.append((text, spans))
    return out


def examples(texts: list[tuple[str, set[Span]]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(features, label) of every candidate, by kind; numbers count for phone and for id."""
    rows: dict[str, tuple[list, list]] = {k: ([], []) for k in KINDS}
    for text, spans in texts:
        seen = set()
        for c in candidates(text):
            for kind in ("phone", "id_number") if c.kind in ("phone", "id_number") else (c.kind,):
                s = Span(c.start, c.end, kind)
                if s not in seen:
                    seen.add(s)
                    rows[kind][0].append(features(text, s))
                    rows[kind][1].append(s in spans)
    return {k: (np.array(x or np.zeros((0, N_FEATURES))), np.array(y, float)) for k, (x, y) in rows.items()}


def train(n: int = TEXTS, seed: int = SEED) -> Model:
    """Boosters fitted on four fifths of the texts; thresholds are those of the best F1 on the rest."""
    texts = labelled_texts(n, seed)
    cut = len(texts) * 4 // 5
    fit, held = examples(texts[:cut]), examples(texts[cut:])
    boosters = {k: boosting.fit(*fit[k]) for k in KINDS}
    limits = {}
    for k in KINDS:
        p, y = boosters[k].score(held[k][0]), held[k][1]
        grid = np.linspace(0.15, 0.85, 29)
        f1 = [2 * ((p >= t) & (y > 0)).sum() / max(1, (p >= t).sum() + y.sum()) for t in grid]
        best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
        limits[k] = float(grid[best[len(best) // 2]])
    return Model(boosters, limits)
