"""Personal details in free text: found, and replaced by placeholders of their type.

High-recall generators propose overlapping spans: mail addresses, also disguised; phone numbers;
identity numbers; street addresses; names of persons, also with no listed name. Boosted trees weigh each span by its
format, its tokens and its context; a threshold per kind, calibrated on held-out rows, selects; of spans
that overlap the one furthest above its threshold stays (ties: the longer, then the earlier).

The trees are fitted on ``SAMPLE`` labelled rows that ``labelled`` composes: a detail of random format among filler
words, with or without a cue word of some class near it. No row is a sentence of any table, and the words of a
class are general vocabulary of eight languages. How often a word stands in lower case is counted over all texts.
Everything runs over all texts, whole. Null and empty texts hold nothing.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import is_small
from .boosting import Boosted, calibrated_threshold

KINDS = ("email", "phone", "identity", "address", "name")
SAMPLE = 9_000  # labelled rows for the trees and their thresholds; bounded whatever the corpus
CASES = 1 << 18  # counters of upper- and lower-case uses of words; fixed, whatever the corpus

# Generators. The format of a span is its place in this list. Public number and address formats.
_AT = r"(?:\s?[\[(]\s?at\s?[\])]\s?| at )"
_DOT = r"(?:\s?[\[(]\s?dot\s?[\])]\s?| dot )"
_STREET = r"(?:street|st|avenue|ave|lane|drive|close|road|rd\b\.?|way|court|crescent|terrace|boulevard|blvd|gardens|grove|row|square|place)(?!\w)"
_WORD = r"[^\W\d_]+(?:[’'-][^\W\d_]+)*"
_MORE = r"(?: [A-ZÀ-ÞĄĆĘŁŃŚŹŻĞİŞА-Я][^\W\d_]*)?"
_UNIT = r"(?:flat|unit|apt|apartment|suite)\.?"
_NUM = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_EXT = r"(?:\s?(?:ext\.?|x)\s?\d{1,5})?"
FORMATS: list[tuple[str, str, re.Pattern[str]]] = [
    (kind, name, re.compile(pattern, re.I if flags else 0))
    for kind, name, flags, pattern in [
        ("email", "plain", 0, r"(?<![\w.+-])[\w][\w.+-]*\s?[@＠]\s?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w@])"),
        ("email", "bracket", 1, rf"(?<![\w.+-])\w[\w.+-]*(?:{_DOT}[\w+-]+)*\s?[\[(]\s?at\s?[\])]\s?[a-z0-9-]+(?:(?:\.|{_DOT})[a-z0-9-]+)+"),
        ("email", "spoken", 1, rf"(?<![\w.+-])\w[\w.+-]*(?:{_DOT}[\w+-]+)* at [a-z0-9-]+(?:{_DOT}[a-z0-9-]+)+"),
        ("phone", "plus", 1, rf"(?<![\w+])\+\d{{1,3}}(?:[\s.-]?\(\d{{1,5}}\))?(?:[\s.-]?\d){{6,12}}{_EXT}(?![\d])"),
        ("phone", "doublezero", 0, r"(?<![\w.+-])00\d{10,13}(?!\d)"),
        ("phone", "area", 1, rf"(?<![\w+])(?<!\d )\(\d{{2,5}}\)\s?\d{{3,4}}[\s.-]?\d{{3,4}}{_EXT}(?!\d)"),
        ("phone", "dots", 0, r"(?<![\w.,+-])\d{3}\.\d{3}\.\d{4}(?![\d.-]\d|\d)"),
        ("phone", "dashes344", 0, r"(?<![\w.-])\d{3}-\d{4}-\d{4}(?![\w-])"),
        ("phone", "dashes343", 0, r"(?<![\w.-])\d{3}-\d{4}-\d{3}(?![\w-])"),
        ("phone", "dashes334", 0, r"(?<![\w.-])\d{3}[-\s]\d{3}[-\s]\d{4}(?![\w-])"),
        ("phone", "groups", 1, rf"(?<![\w.,+/-])(?<!\d )\d{{1,5}}(?:[ -]\d{{2,8}}){{1,5}}{_EXT}(?! ?\d|\w|[.,-]\d)"),
        ("phone", "slash", 0, r"(?<![\w.-])0\d{2,4} ?/ ?\d{3} ?\d{3,5}(?!\d)"),
        ("phone", "words", 1, rf"\b{_NUM}(?: {_NUM}){{6,14}}\b"),
        ("phone", "digits", 0, r"(?<![\w.+,/-])\d{9,12}(?![\w-])"),
        ("identity", "324", 0, r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])"),
        ("identity", "443", 0, r"(?<![\w.-])(?<!\d{4} )\d{4} \d{4} \d{3}(?! ?\d)"),
        ("identity", "333", 0, r"(?<![\w.-])(?<!\d )\d{3}[ -]\d{3}[ -]\d{3}(?![ -]?\d|\w)"),
        ("identity", "dots", 0, r"(?<![\w.-])\d{3}\.\d{3}\.\d{3}-\d{2}(?![\w-])"),
        ("identity", "birth", 0, r"(?<![\w.-])\d{6}-\d{4}(?![\w-])"),
        ("identity", "pairs", 0, r"(?<![\w.-])[A-Z]{2} \d{2} \d{2} \d{2} [A-Z](?!\w)"),
        ("identity", "letter", 0, r"(?<![\w.-])[A-Z]\d{7,8}[A-Z](?![\w-])"),
        ("identity", "letterdash", 0, r"(?<![\w.-])[A-Z]-\d{7}-[A-Z](?![\w-])"),
        ("identity", "passport", 0, r"(?<![\w.-])[A-Z]{1,3}\d{6,8}(?![\w-])"),
        ("identity", "endletter", 0, r"(?<![\w.-])\d{8}-?[A-Z](?![\w-])"),
        ("identity", "plain", 0, r"(?<![\w.+,/-])\d{8,12}(?![\w-])"),
        ("address", "unit", 1, rf"(?<![\w/])(?:{_UNIT} \d+[a-z]?(?:/|,? ))?\d{{1,4}}[a-z]? (?:{_WORD} )?{_WORD} {_STREET}(?:, {_UNIT} \d+[a-z]?)?(?!\w)"),
        ("address", "rue", 0, rf"(?<![\w/])\d{{1,4}}(?: bis| ter)?,? (?:rue|avenue|allée|chemin) (?:de la |de l’|du |des |de )?{_WORD}{_MORE}"),
        ("address", "rue", 0, rf"(?<![\w/])\d{{1,4}}(?: bis| ter)?,? (?:rue|avenue|allée|chemin) (?:de la |de l’|du |des |de )?{_WORD}"),
        ("address", "rua", 0, rf"\b(?:Rua|Calle|Avenida|Via|Plaza|Paseo) (?:da |do |de la |de |del )?{_WORD}{_MORE},? \d{{1,4}}[a-z]?(?![\w-])"),
        ("address", "ul", 0, rf"\b(?:ul|al|os)\. {_WORD}{_MORE} \d{{1,4}}[a-z]?(?:/\d+)?(?!\w)"),
        ("address", "улица", 0, rf"\b(?:ул|пр|пер|наб)\. {_WORD}, д\. \d{{1,4}}(?:, кв\. \d+)?"),
        ("address", "straße", 1, r"\b[^\W\d_]{3,}(?:straße|strasse|str\.|weg|gasse|platz|allee) \d{1,4}[a-z]?(?!\w)"),
        ("address", "sokak", 0, rf"\b{_MORE[4:-2]}{_MORE} (?:Sokak|Sk\.|Caddesi|Cad\.|Mahallesi) No: ?\d+(?:/\d+)?"),
    ]
]
NAME_FORMAT = len(FORMATS)
DIGITISH = re.compile(r"\d\D{0,4}\d\D{0,4}\d\D{0,4}\d\D{0,4}\d\D{0,4}\d")
NUMBERED = [i for i, (kind, name, _) in enumerate(FORMATS) if kind in ("phone", "identity") and name != "words"]
DIGIT, MAILISH = re.compile(r"\d"), re.compile(r"[\w.+-]\s?[@＠]\s?[\w-]+\.")
#: What a text must contain for an address format to be tried.
HINTS = [
    (i, hints.split("|"))
    for n, hints in {
        "unit": " st|avenue| ave| lane| drive| close| road| rd| way| court| cresc| terr| boul| blvd| gard| grove| row| square| place",
        "rue": " rue | avenue | allée | chemin ",
        "rua": "rua |calle |avenida |via |plaza |paseo ",
        "ul": "ul. |al. |os. ",
        "улица": "ул. |пр. |пер. |наб. ",
        "straße": "straße |strasse |str. |weg |gasse |platz |allee ",
        "sokak": " no:",
    }.items()
    for i, (kind, name, _) in enumerate(FORMATS)
    if kind == "address" and name == n
]
SPOKEN = tuple(f" {w} " for w in _NUM[3:-1].split("|"))  # every match of "words" has one, unless written with a letter of "ſıİ"
WORDED = next(i for i, (_, name, _) in enumerate(FORMATS) if name == "words")
TOKEN = re.compile(r"[^\W\d_]+(?:[’'‑-][^\W\d_]+)*")
PARTICLES = frozenset("van von de der den del della di da dos du la le el al bin ibn ter ten zu".split())

#: General vocabulary by class, in English, German, French, Spanish, Portuguese, Polish, Turkish and Russian.
CUES = {
    "phone": "phone phones telephone tel mobile cell cellphone landline hotline helpline fax call calls called calling dial ring text sms whatsapp signal voicemail number extension telefon telefonnummer handy handynummer anruf anrufen ruf téléphone portable appelez appeler joindre numéro teléfono móvil celular llama llamar llame número telefone telemóvel ligue ligar telefonu zadzwoń dzwonić numer komórka komórkę cep ara arayın numara telefonum телефон телефона звони звонить позвони позвоните номер тел",
    "identity": "passport passports id ids identity identification identifier national social security ssn insurance tax taxpayer tin visa citizen citizens citizenship residence permit immigration consulate embassy card licence license pass personal personalausweis ausweis reisepass steuer steuernummer steuer-id sozialversicherung identité passeport sécurité sociale carte dni nie nif pasaporte identidad documento cpf rg passaporte identidade contribuinte dowód dowodu pesel paszport nip kimlik pasaport vergi паспорт паспорта удостоверение снилс инн",
    "other": "order orders parcel package packet shipment shipped delivery tracking consignment flight ticket tickets booking reservation invoice receipt bill account customer case model serial device part sku isbn issn doi version release build firmware patch lottery bingo score result page volume edition chapter room gate seat platform ref reference catalogue catalog barcode batch imei port error code patent sensor meter bestellung paket sendung rechnung flug commande colis facture vol billet pedido factura vuelo encomenda fatura voo zamówienie paczka faktura lot sipariş kargo uçuş заказ посылка счёт рейс билет",
    "line": "bus buses train trains tram trams line route metro ferry coach platform autobus autobús zug bahn tren trem pociąg tramwaj otobüs поезд автобус трамвай",
    "unit": "km kilometres kilometers metres meters miles steps feet kg grams euro euros dollars pounds cents people persons guests percent degrees hours hour minutes minute seconds days nights weeks months years times pages views votes points followers pies pieces litres goals kilometer meter schritte grad tage jahre pas mètres jours heures euros pasos grados días horas passos dias horas kroków dni godzin adım gün saat шагов километров дней часов",
    "title": "mr mrs ms miss dr prof professor herr frau mme mlle monsieur madame sr sra señor señora dom dona pan pani pana bay bayan",
    "role": "neighbour neighbor friend friends colleague coworker cousin uncle aunt brother sister mother father mum dad son daughter wife husband partner boss manager landlord landlady tenant plumber electrician doctor dentist nurse vet teacher coach tutor student driver waiter lawyer judge referee captain author editor director chairman president minister mayor pastor singer actor actress painter baker clerk officer sergeant accountant guard gardener caretaker witness defendant suspect winner guest speaker nachbar nachbarin freund freundin kollege kollegin chef lehrer lehrerin arzt ärztin onkel tante voisin voisine ami amie collègue médecin gardien oncle prima primo vecino vecina amigo amiga colega jefe jefa tío tía vizinho vizinha amigo chefe tio tia sąsiad sąsiadka kolega koleżanka szef wujek ciocia komşu komşum arkadaş arkadaşım öğretmen amca teyze сосед соседка друг подруга коллега врач учитель дядя тётя",
    "person": "by with met meet thank thanks congrats congratulations welcome dear hi hello hey signed regards sincerely yours contact ask tell named ask invite invited married hired hire interview interviewed beside know knows knew asked told saw seen for and from belonged avec con mit com z ze с со от von por ile",
    "does": "says said wrote told will was is has had never always sent asked phoned lives lived works worked plays played sings chaired won lost met stopped forgot feeds retires retired builds built arrived answered answers owes smiled laughed called thinks sagt sagte ist hat dit est a dice dijo es canta disse é mówi jest powiedział diyor söyledi dedi говорит сказал сказала",
    "place": "in near at to towards around over above across between beyond outside inside through via past reach reached toward into à en au aux dans vers chez nach bei über um zwischen durch aus entre hacia sobre hasta para em na no até w we do nad koło przez в на из около над до между через",
    "common": "garden gardens park street road avenue lane station bridge bridges festival museum airport hotel harbour harbor river lake valley bay island mountain tower hall school university college church castle market square library hospital club team band company motors bakery bank group union league party day days week month morning evening night afternoon period words year season news report meeting review line match lion market post times tours gmbh ltd inc sons store shop café restaurant theatre cinema beach coast hill hills view sokak cadde caddesi straße strasse platz rue calle rua via plaza avenida ulica улица geburtstag",
    "address": "lives live living lived moved move moving address street flat home house apartment office visit deliver delivered post pick meet drop ring wohne wohnt wohnen ziehe adresse anschrift habite habitent habitons logement vivo vive vivimos dirección moro mora moramos endereço mieszkam mieszka mieszkanie adres oturuyorum oturuyor adresim живу живёт живем адрес адресу",
    "mail": "mail email e-mail mails write writes reply replies send contact address inbox subscribe complaints bookings questions schreib schreiben schicken écrire écrivez envoyez escribe escriba envía escreva envie napisz pisz yaz yazın пиши пишите почта адрес",
}
CLASS = {w: i for i, (_, ws) in reversed(list(enumerate(CUES.items()))) for w in ws.split()}
#: General vocabulary: frequent words, some of which are also names.
FREQUENT = frozenset(
    "the a an and or but if when while where why who how what which this that these those my our your his her their its we you they he she it i not no yes all some any every each other another same "
    "back just here there now then today tomorrow yesterday tonight again still yet also very too more most less new old good great big small last next first second third early late happy annual final "
    "only almost about after before during since until because so than like just even such both one two three four five six seven eight nine ten der die das ein eine und oder aber wenn wir ihr sie er es nicht neu neue neuer alte "
    "le la les un une et ou mais si nous vous ils elle il pas el los las una y o pero nosotros os as um uma e ou mas não nós i lub ale nie to jest my ve bir bu şu çok и или но не это мы вы они он она".split()
)
#: General vocabulary: given names in wide use.
GIVEN = frozenset(
    "james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony donald steven paul andrew joshua kenneth kevin brian george timothy ronald edward jason jeffrey jacob gary nicholas eric jonathan stephen larry justin scott brandon benjamin samuel gregory "
    "patrick frank peter henry mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy betty margaret sandra ashley kimberly emily donna michelle carol amanda dorothy melissa deborah stephanie rebecca sharon laura cynthia kathleen amy angela anna emma olivia sophia kim lee "
    "maria elena lucia carmen ana carlos jose juan luis miguel pedro antonio manuel francisco joao paulo rafael andreas hans klaus jürgen wolfgang stefan martin heinrich henrik karl ursula ingrid monika petra sabine olivier pierre jean michel claude marie nathalie isabelle françois luc giulia marco paolo francesca "
    "piotr krzysztof agnieszka katarzyna jan tomasz ewa mehmet mustafa ahmet ayşe fatma emre ivan dmitri sergei olga natalia tatiana alexei igor svetlana priya raj amit yuki kenji wei mei fatima ali omar hassan aisha kwame chidi lars sven astrid erik liam noah".split()
)
#: General vocabulary: endings of family names, of places.
FAMILY = tuple("son sen sson ski ska sky cki wicz czyk ov ova ev eva enko yan ian dze vili shvili oglu oğlu man mann berg stein feld ez es ini elli etti eau ard ström qvist lund dahl idis poulos escu kaya demir ić ing ton well ham field smith er ский ская цкий цкая ов ова ев ева ин ина енко".split())
TOWN = tuple("ville burg bourg borough bury grad gorod sk hausen hausen heim dorf stadt bach kirchen mouth stead mere wick wich minster port pool combe haven holm holt köy hisar court gnac lomas dale gate brook land ия град ск".split())
PLACED = tuple("new old north south east west upper lower great little fort port saint st san santa são mount mont bad nowy nowa stary stara novo nova yeni eski нижний верхний новый старый villa vila ville".split())
SPLIT = re.compile(r"[^\s,;:!?()\[\]“”\"]+")
TOP_LEVEL = frozenset("com org net edu gov int info biz io co de fr es pt pl tr ru uk us eu it nl ch at se no fi example test invalid".split())
CONTEXT = 44


class Finder:
    """Generators and features; ``given`` are known given names, ``places`` names of places, ``usage`` tells how words are written."""

    def __init__(self, given: list[str], places: list[str]) -> None:
        self.given = {n.lower() for n in given}
        self.heads, self.tails = {n[:3] for n in self.given if len(n) > 4}, {n[-3:] for n in self.given if len(n) > 4}
        self.places = {w.lower() for p in places for w in TOKEN.findall(p) if len(w) > 2}
        self.usage: np.ndarray | None = None  # per bucket 0 unknown, 1 nearly always with a capital, 2 mixed, 3 mostly in lower case, 4 only where a sentence starts
        self.said: dict[str, int] = {}  # the same by word; while fitting
        self.flags: dict[str, tuple[int, ...]] = {}

    def use(self, low: str) -> int:
        if low in FREQUENT:
            return 3
        if self.usage is None:
            return self.said.get(low, 0)
        return int(self.usage[zlib.crc32(low.encode()) % CASES])

    def flag(self, token: str) -> tuple[int, ...]:
        """(known given name, like one, ends like a family name, part of a place, ends like a place, class, usage, capital, all capitals, length)."""
        known = self.flags.get(token)
        if known is None:
            low = token.lower()
            last = low.replace("‑", "-").split("-")
            known = (
                2 * (low in self.given) or int(low in GIVEN), int(len(low) > 4 and low[:3] in self.heads and low[-3:] in self.tails), int(len(low) > 4 and low.endswith(FAMILY)),
                2 * (low in PLACED) or int(low in self.places or any(x in self.places for x in last)), int(len(low) > 5 and low.endswith(TOWN)), CLASS.get(low, -1) + 1,
                self.use(low), int(token[:1].isupper()), int(token.isupper() and len(token) > 1), min(len(token), 12),
            )
            if len(self.flags) > 300_000:
                self.flags.clear()
            self.flags[token] = known
        return known

    def names(self, text: str) -> Iterator[tuple[int, int, int, list[str]]]:
        """Spans that may be a person's name: (start, end, form, [given, family]); form 1 with initial, 2 family name first, 3 with particles, 4 with two given names."""
        tokens = [(m.start(), m.end(), m.group()) for m in TOKEN.finditer(text)]
        for i in range(len(tokens) - 1):
            a, b, x = tokens[i]
            c, d, y = tokens[i + 1]
            gap = text[b:c]
            if gap not in (" ", ", ", ". ") or a and text[a - 1] in "@#_+/":
                continue
            f, g = self.flag(x), self.flag(y)
            if gap == ", ":
                if len(y) > 2 and len(x) > 2 and f[7] == g[7] and (g[0] or g[1] or f[7] and f[6] < 2 and g[6] < 2 and not f[3]) and not self.handled(text, d):
                    yield a, d, 2, [y, x]
                continue
            if gap != " " or len(x) < 2:
                continue
            if len(y) == 1 and y.isupper() and i + 2 < len(tokens) and text[d : tokens[i + 2][0]] in (". ", " "):
                _, e, z = tokens[i + 2]
                if f[7] and self.flag(z)[7] and len(z) > 1 and not self.handled(text, e):
                    yield a, e, 1, [x, z]
                continue
            if len(y) < 2 or f[5] == TITLE:
                continue
            alike = f[7] == g[7]
            if alike and len(y) > 2 and (f[0] or f[1] or f[7] and f[6] < 3 and g[6] < 3) and not self.handled(text, d):
                yield a, d, 0, [x, y]
            if not f[7] or not (f[0] or f[1] or f[6] < 2):
                continue
            k, e, z = i + 1, d, y
            while k + 1 < len(tokens) and k < i + 3 and z in PARTICLES and text[e : tokens[k + 1][0]] == " ":
                k += 1
                _, e, z = tokens[k]
            if k > i + 1 and z[0].isupper() and not self.handled(text, e):
                yield a, e, 3, [x, z]
            elif k == i + 1 and g[7] and f[0] and (g[0] or g[1]) and i + 2 < len(tokens) and text[d : tokens[i + 2][0]] == " ":
                _, e, z = tokens[i + 2]
                if z[0].isupper() and len(z) > 2 and not self.handled(text, e):
                    yield a, e, 4, [x, z]

    @staticmethod
    def handled(text: str, end: int) -> bool:
        """Whether the span runs into something that makes it part of an address or handle."""
        return end < len(text) and (text[end] in "_@＠+" or text[end].isdigit() or (text[end] in ".-" and end + 1 < len(text) and text[end + 1].isalnum()))

    def spans(self, text: str) -> list[tuple[int, int, int, int, list[str]]]:
        """All proposed spans: (start, end, format, form, names)."""
        out, chosen, low = [], [], text.lower()
        if ("@" in low or "＠" in low) and MAILISH.search(text):
            chosen.append(0)
        if "at]" in low or "at)" in low or "at )" in low or "at ]" in low:
            chosen.append(1)
        if "dot" in low:
            chosen.append(2)
        if DIGIT.search(text):
            chosen += [k for k, hints in HINTS if any(h in low for h in hints)]
            if DIGITISH.search(text):
                chosen += NUMBERED
        if any(w in low for w in SPOKEN) or any(c in text for c in "ſıİ"):
            chosen.append(WORDED)
        for k in chosen:
            for m in FORMATS[k][2].finditer(text):
                out.append((m.start(), m.end(), k, 0, []))
        out += [(a, e, NAME_FORMAT, form, pair) for a, e, form, pair in self.names(text)]
        return out

    def features(self, text: str, span: tuple[int, int, int, int, list[str]]) -> list[int]:
        start, end, k, form, pair = span
        found = text[start:end]
        row = [0] * (NAME_FORMAT + 1 + 2 * len(CUES))
        row[k] = 1
        near = [[w.lower().strip(".’'—/-") for w in ws] for ws in (reversed(SPLIT.findall(text[max(0, start - CONTEXT) : start])[-4:]), SPLIT.findall(text[end : end + CONTEXT])[:4])]
        for side, ws in enumerate(near):
            at = NAME_FORMAT + 1 + side * len(CUES)
            for i, w in enumerate(ws):
                c = CLASS.get(w, -1)
                if c >= 0 and not row[at + c]:
                    row[at + c] = 4 - i
        starts = start == 0 or text[max(0, start - 2) : start].rstrip()[-1:] in (*"\n.!?…:—", "")
        ends = end == len(text) or text[end] in "\n.,;:!?)"
        row += [int(starts), int(ends), int(found.isupper()), int(found.islower())]
        if not pair:
            digits = [c for c in found if c.isdigit()]
            groups = re.findall(r"\d+", found)
            row += [min(len(digits), 20), min(len(found), 60) // 3, min(found.count(" "), 9), min(found.count("-") + found.count("."), 9), int(bool(digits) and digits[0] == "0"), min(len(groups), 6), min(len(groups[0]), 6) if groups else 0, min(len(groups[-1]), 8) if groups else 0]
            words = [w for w in TOKEN.findall(found) if w.lower() not in ("flat", "unit", "apt", "apartment", "suite")] if FORMATS[k][0] == "address" else []
            row += [len({w[0].isupper() for w in words}), max((self.use(w.lower()) for w in words[:-1]), default=0), self.use(words[-1].lower()) if words else 0, int(not ends and text[end : end + 2].strip().islower())]
            labels = re.split(r"[@＠]|\bat\b", found, flags=re.I)[-1] if FORMATS[k][0] == "email" else ""
            last = re.findall(r"[^\W_]+", labels)[-1:]
            row += [int(bool(last) and last[0].lower() in TOP_LEVEL), int(bool(last) and last[0].isalpha()), int(any(c.isalpha() for c in found[:3]))] + [0] * 28
        else:
            f, g = self.flag(pair[0]), self.flag(pair[1])
            before = TOKEN.findall(text[max(0, start - 24) : start])[-1:]
            after = TOKEN.match(text, end + 1) if text[end : end + 1] == " " else None
            joined = [before and text[start - 1 : start] == " " and before[0][0].isupper() and text[max(0, start - 2)] not in ".!?,:", after is not None and after[0][0].isupper()]
            p, q = (self.flag(before[0]) if before else (0,) * 10), (self.flag(after[0]) if after else (0,) * 10)
            row += [0] * 15 + [form, *f[:5], f[6], f[8], *g[:5], g[6], f[9], g[9], int(bool(joined[0])), int(joined[1]), p[3], p[6] if before else 4, p[5], q[6] if after else 4, q[5], int(f[5] == COMMON), int(g[5] == COMMON), int(f[5] == PLACE), int(f[5] > 0), int("’" in pair[1] or "-" in pair[1])]
        return row


TITLE, COMMON, PLACE = (list(CUES).index(c) + 1 for c in ("title", "common", "place"))


def labelled(given: list[str], places: list[str], n: int, seed: int = 11) -> tuple[list[tuple[str, list[tuple[int, int, str]]]], dict[str, int]]:
    """Texts with the spans of their details, and how their words are usually written: the labelled rows the trees are fitted on.

    A row is composed, not quoted: filler words, perhaps a cue word, a detail or something that looks like one.
    """
    r = random.Random(seed)
    given, places = sorted(given) or ["Ada"], sorted(places) or ["Arden"]
    pick, chance = r.choice, lambda p: r.random() < p
    words = {c: ws.split() for c, ws in CUES.items()}
    fillers = sorted(FREQUENT)
    usage: dict[str, int] = {w: 3 for ws in words.values() for w in ws}
    digits = lambda k: "".join(pick("0123456789") for _ in range(k))
    letters = lambda k: "".join(pick("ABCDEFGHJKLMNPRSTVWXYZ") for _ in range(k))
    number = lambda a, b: str(r.randint(a, b))
    wide = sorted(w.capitalize() for w in GIVEN)
    ambiguous = [w for w in sorted(GIVEN | {g.lower() for g in given}) if len(w) < 6]

    def syllables(a: int, b: int) -> str:
        onset, core, coda = "b c d f g h k l m n p r s t v w z br dr gr kr tr st sch th".split(), "a e i o u au ei ó é".split(), ["", "", "", "n", "r", "l", "s", "m", "k"]
        return "".join(pick(onset) + pick(core) + pick(coda) for _ in range(r.randint(a, b)))

    def noun() -> str:
        w = syllables(1, 3)
        usage[w] = r.choices((0, 3), (3, 7))[0]
        return w

    def opener() -> str:
        """A common word where a sentence starts."""
        w = syllables(1, 3)
        usage[w] = r.choices((0, 3, 4), (1, 4, 5))[0]
        return w.capitalize() if chance(0.75) else pick(fillers + words["place"]).capitalize()

    def usual(w: str, weights: tuple[float, ...]) -> str:
        for part in TOKEN.findall(w):
            usage.setdefault(part.lower(), r.choices((0, 1, 2, 3), weights)[0])
        return w

    def family() -> str:
        s = syllables(1, 2).capitalize() + (pick([x for x in FAMILY if x.isascii() or chance(0.2)]) if chance(0.5) else "")
        return usual(("O’" if chance(0.05) else "") + s + ("-" + syllables(1, 2).capitalize() if chance(0.08) else ""), (5, 4, 0.4, 0.05))

    def first() -> str:
        x = r.random()
        w = pick(given) if x < 0.5 else pick(wide) if x < 0.7 else pick(given)[:3] + pick(given)[-3:] if x < 0.8 else syllables(2, 3).capitalize()
        return usual(w, (2, 5, 1, 0.1))

    def name() -> str:
        if chance(0.06):
            return usual(pick("Анна Иван Ольга Сергей Мария Пётр Елена".split()), (2, 5, 1, 0)) + " " + usual("".join(pick("бвгдкмнрст") + pick("аеио") for _ in range(2)).capitalize() + pick("ский ская ов ова ин ина".split()), (5, 4, 0, 0))
        f, s = first(), family()
        x = r.random()
        if x < 0.14:
            return f"{f} {letters(1)}. {s}"
        if x < 0.24:
            return f"{s}, {f}"
        if x < 0.28:
            return f"{f} {pick('van von de del di da van‑der'.split()).replace('‑', ' ')} {s}"
        out = f"{f} {s}"
        listed = f in given
        return out.upper() if chance(0.07) else out.lower() if listed and chance(0.14) else out

    def mail() -> str:
        latin = lambda a, b: syllables(a, b).replace("é", "e").replace("ó", "o")
        local = pick([latin(1, 2), f"{latin(1, 2)}.{latin(1, 2)}", f"{pick(given).lower()}_{digits(2)}", f"{letters(1).lower()}.{latin(1, 2)}", f"{latin(2, 2)}+{latin(1, 1)}", f"{latin(1, 2)}-{digits(2)}"])
        host, top = pick([latin(1, 3), f"{latin(1, 1)}.{latin(1, 2)}", f"{latin(1, 2)}-{latin(1, 1)}"]), pick(sorted(TOP_LEVEL))
        spoken = local.replace(".", " dot ") if chance(0.5) else local
        out = pick([f"{local}@{host}.{top}"] * 4 + [f"{local} [at] {host}.{top}", f"{local} [at] {host} [dot] {top}", f"{local}(at){host}(dot){top}", f"{spoken} at {host.replace('.', ' dot ')} dot {top}", f"{local} @ {host}.{top}", f"{local}＠{host}.{top}"])
        return out.upper() if chance(0.05) else out

    def grouped(total: int, lead: str, gaps: str) -> str:
        """``total`` digits in groups of two to four."""
        d, gap, parts = lead + digits(total - len(lead)), pick(gaps), []
        while d:
            k = min(len(d), r.randint(2, 4)) if len(d) > 4 else len(d)
            parts.append(d[:k])
            d = d[k:]
        return gap.join(parts)

    def phone() -> str:
        """In clear formats, and in plain groups (these with a cue, unless they begin with 0)."""
        d, area = digits, number(10, 999)
        said = " ".join(pick("zero oh one two three four five six seven eight nine".split()) for _ in range(r.choice([7, 8, 10, 11])))
        out = pick([f"+{area} {grouped(r.randint(7, 10), '', ' -.')}", f"+{area} {d(3)} {d(r.randint(6, 8))}", f"+{d(r.randint(10, 12))}", f"+{area} (0){d(2)} {d(6)}", f"+{number(1, 99)} ({d(3)}) {d(3)}-{d(4)}", f"+{area}-{d(3)}-{d(3)}-{d(4)} ext. {d(2)}", f"00{d(r.randint(10, 12))}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(4)}-{d(4)}", f"{d(3)}-{d(4)}-{d(3)}", f"{d(3)}-{d(3)}-{d(4)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", grouped(r.randint(9, 11), "0", " "), grouped(r.randint(9, 11), "0", " -"), f"0{d(3)} {d(6)}", f"0{d(2)} {d(7)}", f"0{d(3)} / {d(3)} {d(4)}", f"0{d(9)}", said])
        return out.translate({48 + i: 0xFF10 + i for i in range(10)}) if chance(0.05) and "+" not in out else out

    def identity() -> str:
        d = digits
        return pick([f"{d(3)}-{d(2)}-{d(4)}"] * 3 + [f"{d(4)} {d(4)} {d(3)}", f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", f"{d(6)}-{d(4)}", f"{letters(2)} {d(2)} {d(2)} {d(2)} {letters(1)}", f"{letters(1)}{d(7)}{letters(1)}", f"{letters(2)}{d(7)}", f"{letters(1)}{d(8)}", f"{letters(3)}{d(6)}", f"{letters(1)}-{d(7)}-{letters(1)}", f"{d(8)}{letters(1)}", f"{d(3)} {d(3)} {d(3)}", d(11), d(9)])

    def address() -> str:
        s, n = usual(syllables(1, 3).capitalize(), (4, 3, 1, 0.3)), number(1, 320)
        s = pick(["Queen", "Mill", "Church", "Garden", "Fourth", "Mayor"]) if chance(0.12) else s
        two, kind = (s + " " + pick("Hill Park Mill Bridge Green Cross".split()) if chance(0.25) else s), pick("Street St Avenue Lane Road Rd. Close Drive Way Court Crescent Terrace Gardens Grove Square".split())
        plain = f"{n}{pick(['', '', 'a', 'b'])} {two} {kind}"
        return pick([plain, plain, plain, plain.upper(), plain.lower(), f"Flat {number(1, 30)}, {plain}", f"{plain}, Apt {number(1, 30)}", f"Unit {number(1, 30)}/{plain}", f"{n} rue {two}", f"{n} bis, rue de la {two}", f"Rua {two}, {n}", f"Calle {two} {n}", f"ul. {two} {n}/{number(1, 30)}", f"ул. {pick(['Садовая', 'Школьная', 'Мира'])}, д. {n}", f"{s}straße {n}", f"{s}weg {n}{pick('abc')}", f"{two} Sokak No: {n}"])

    def town() -> str:
        """A place, listed or not; many end like a family name."""
        if chance(0.4):
            return usual(pick(places), (2, 5, 0.3, 0))
        made = usual(syllables(1, 2).capitalize() + (pick(TOWN) if chance(0.6) else pick(FAMILY) if chance(0.3) else ""), (4, 4, 0.3, 0))
        return f"{pick(PLACED).capitalize()} {made}" if chance(0.45) else made

    def some(k: int) -> str:
        return " ".join(pick(fillers) if chance(0.6) else noun() for _ in range(k))

    def cue(*classes: str) -> str:
        return pick(words[pick(classes)])

    make = {"name": name, "email": mail, "phone": phone, "identity": identity, "address": address}
    helps = {"name": ("title", "role", "person", "person"), "email": ("mail", "mail", "person"), "phone": ("phone",), "identity": ("identity",), "address": ("address", "address", "place")}

    def join(*parts: str) -> str:
        return " ".join(p for p in parts if p)

    def written(kind: str) -> tuple[str, list[tuple[int, int, str]]]:
        detail = make[kind]()
        plain = kind == "phone" and re.fullmatch(r"[1-9][\d -]+", detail) and not re.fullmatch(r"1?-?\d{3}-\d{3}-\d{4}|\d{3}-\d{4}-\d{3,4}", detail)
        bare = kind == "identity" and re.fullmatch(r"\d{9,12}|\d{3} \d{3} \d{3}", detail)
        before, after = some(r.choice([0, 0, 1, 1, 2, 3])), ""
        if plain or bare or chance(0.6 if kind != "name" else 0.65):
            if chance(0.85):
                before = join(before, cue(*helps[kind]), some(r.choice([0, 0, 0, 1, 2])) if kind != "name" else "") + pick(["", "", "", ":", ",", "."] if kind != "name" else ["", "", "", ","])
            else:
                after = cue("does" if kind == "name" else helps[kind][0])
        if kind == "name" and chance(0.35):
            after = cue("does")
        if chance(0.15):
            before = join(cue("other", "line", "unit"), some(r.choice([1, 2])) + ",", before)  # about something else
        if chance(0.08):
            after = opener()  # the next sentence, without a stop
        after = join(after, some(r.choice([0, 0, 1, 2])), cue("place") + " " + town() if chance(0.2) else "")
        before = before[:1].upper() + before[1:] if chance(0.6) else before
        glue = pick(["", "", "", ",", ".", "!", "?"])
        text = join(before, detail + (glue if not after or glue in ",." else ""), after)
        at = len(before) + 1 if before else 0
        return text, [(at, at + len(detail), kind)]

    def harmless() -> str:
        d, x = digits, r.random()
        head = some(r.choice([0, 1, 2]))
        head = head[:1].upper() + head[1:] if chance(0.6) else head
        tail = some(r.choice([0, 1, 2]))
        if x < 0.3:  # numbers of things: any format, told by a word beside it
            thing = pick([phone, identity, identity, lambda: grouped(r.randint(6, 12), "", " -."), lambda: f"{letters(2)} {d(4)}", lambda: f"{d(2)}.{d(2)}.{d(3)}", lambda: f"{d(3)}-{d(2)}-{d(5)}"])()
            while not re.match(r"[A-Z]|[1-9][\d .-]*\d|0\d\d[ .-]\d{2,3}[ .-]", thing):
                thing = identity()  # a clear telephone number is no number of a thing
            return join(head, cue("other"), some(r.choice([0, 0, 1, 2])), thing, tail) if chance(0.85) else join(head, thing, cue("other"), tail)
        if x < 0.38:  # amounts, times, dates, points on a map
            return join(head, pick([f"{d(2)} {d(3)} {d(3)}", f"{d(2)} {d(3)}", f"{d(4)} {d(4)}", grouped(r.randint(6, 10), "", " "), d(r.randint(4, 9))]), cue("unit"), tail) if chance(0.5) else join(head, pick([f"{d(2)}:{d(2)}", f"{number(1900, 2030)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.{number(1900, 2030)}", f"{d(2)}.{d(4)}, -{d(2)}.{d(4)}", f"{d(1)}.{d(3)},{d(2)}", f"{d(3)} : {d(3)}", f"{d(2)} - {d(2)}", " ".join(number(1, 60) for _ in range(r.randint(3, 7)))]), tail)
        if x < 0.44:
            return join(head, f"{noun()} {d(1)}@{d(1)}.{d(2)}", tail) if chance(0.4) else join(head, f"{noun()}@{pick(fillers)}" if chance(0.5) else f"{noun()} at {noun()} dot {noun()}", tail)
        if x < 0.56:  # streets without a house, numbers before streets
            s, kind = usual(syllables(1, 2).capitalize(), (4, 3, 1, 0.3)), pick("Street Road Lane Avenue Square".split())
            return pick([join(f"{s} {kind}", cue("does"), tail), join(f"{s} {kind}", some(1), tail), join(head, cue("line"), number(1, 320), some(r.choice([1, 1, 2])), f"{s} {kind}", tail), join(head, cue("place"), f"{s} {kind}", tail), join(head, number(2, 90), noun() if chance(0.5) else "", f"{kind.lower()} {noun()}s", tail), join(head, number(2, 90), cue("unit"), cue("place"), f"{s} {kind}", tail)])
        if x < 0.71:  # places where a name might stand
            lead = cue("place") if chance(0.6) else cue("person", "does") if chance(0.5) else some(1)
            start = join(head, lead) if chance(0.6) else opener()
            return join(start, town(), pick(["", "", cue("common"), cue("does"), f"and {town()}"]), tail)
        if x < 0.88:  # names that are words, and titles of things
            w, c = pick(ambiguous) if chance(0.7) else pick(given).lower(), pick(words["common"]) if chance(0.8) else noun()
            usage.setdefault(w, r.choice((1, 2)))
            start, tail = head if chance(0.6) else "", join(cue("does"), tail) if chance(0.45) else tail
            return pick([
                join(start, f"{w.capitalize()} {c.capitalize()}", tail), join(start, f"{w.capitalize()} {c.capitalize()}", cue("place"), town()), join(w.capitalize(), pick(fillers), noun(), tail), join(start, w, noun(), tail), join(start, w, c, tail),
                join(start, f"{noun().capitalize()} {c.capitalize()}", tail), join(start, f"{usual(syllables(1, 2).capitalize(), (4, 3, 1, 0.3))} {pick('Street Road Lane Avenue Square'.split())}", cue("does"), tail), join(start, f"{family()} {pick('Motors GmbH Ltd Group Bakery Store Hotel Bank Club'.split())}", tail),
                join(opener(), town(), tail), join(opener(), opener(), cue("place"), town()),
            ])
        if x < 0.92:  # a name alone is no full name
            return join(head, cue("title", "role").capitalize(), pick([first(), family()]), cue("does"), tail)
        if x < 0.95:
            return join(opener(), f"{noun().capitalize()}", tail) if chance(0.5) else join(head, f"{noun().capitalize()} {noun().capitalize()}", tail)
        return join(head, some(3), cue("common"), tail).upper() if chance(0.5) else join(head, " ".join(noun() for _ in range(3)).upper(), tail)

    out = []
    for _ in range(n):
        text, spans = (f"@{pick(given).lower()}{digits(3)} " if chance(0.2) else ""), []
        for k in range(r.choice([1, 1, 2, 3])):
            part, found = written(pick(KINDS)) if chance(0.5) else (harmless(), [])
            text += pick([". ", " — ", " // ", "\n", "! ", "? "]) if k else ""
            spans += [(a + len(text), e + len(text), kind) for a, e, kind in found]
            text += part
        out.append((text, spans))
    return out, usage


class Selector:
    """Trees and thresholds over a finder's spans."""

    def __init__(self, given: list[str], places: list[str], sample: int = SAMPLE, usage: np.ndarray | None = None) -> None:
        self.finder = Finder(given, places)
        texts, self.finder.said = labelled(given, places, sample)
        rows, truth, kinds, part = [], [], [], []
        for i, (text, spans) in enumerate(texts):
            true = {*spans}
            for span in self.finder.spans(text):
                kind = FORMATS[span[2]][0] if span[2] < NAME_FORMAT else "name"
                rows.append(self.finder.features(text, span))
                truth.append((span[0], span[1], kind) in true)
                kinds.append(KINDS.index(kind))
                part.append(i % 3 == 0)
        x, y, kinds, held = np.array(rows, dtype=np.int64), np.array(truth, dtype=float), np.array(kinds), np.array(part)
        self.trees, self.threshold = [], []
        for k in range(len(KINDS)):
            mine = kinds == k
            trees = Boosted(rounds=80, depth=3).fit(x[mine & ~held], y[mine & ~held])
            self.trees.append(trees)
            self.threshold.append(calibrated_threshold(trees.score(x[mine & held]), y[mine & held]))
        self.finder.usage, self.finder.flags = usage, {}

    def select(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """Of each text the selected details (start, end, kind), in order, without overlap."""
        owner, spans, rows, kinds = [], [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            for span in self.finder.spans(text):
                owner.append(i)
                spans.append(span)
                kinds.append(KINDS.index(FORMATS[span[2]][0]) if span[2] < NAME_FORMAT else 4)
                rows.append(self.finder.features(text, span))
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not rows:
            return out
        x, kind = np.array(rows, dtype=np.int64), np.array(kinds)
        over = np.empty(len(rows))
        for k, trees in enumerate(self.trees):
            mine = kind == k
            if mine.any():
                over[mine] = trees.score(x[mine]) - self.threshold[k]
        chosen: dict[int, list[tuple[int, int, str]]] = {}
        order = sorted((j for j in range(len(rows)) if over[j] > 0), key=lambda j: (-round(float(over[j]), 1), spans[j][0] - spans[j][1], spans[j][0]))
        for j in order:
            a, e = spans[j][:2]
            mine = chosen.setdefault(owner[j], [])
            if all(e <= b or a >= c for b, c, _ in mine):
                mine.append((a, e, KINDS[kind[j]]))
        for i, found in chosen.items():
            out[i] = sorted(found)
        return out


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """``text`` with each detail replaced by a placeholder such as ``[PHONE]``."""
    at, parts = 0, []
    for a, e, kind in found:
        parts += [text[at:a], f"[{kind.upper()}]"]
        at = e
    return "".join([*parts, text[at:]])


def word_usage(texts: DataFrame, text: str) -> np.ndarray:
    """How words are written in all texts, by bucket of the lower-cased word (see ``Finder.usage``). ``CASES`` rows at most reach the driver."""
    t, lower, upper = F.col(f"`{text}`"), r"\p{L}{2,}", r"(?:^|[.!?…\n/—:]\s*|@\w+ )(\p{L}{2,})"
    starts = F.regexp_extract_all(t, F.lit(upper), F.lit(1))
    every = F.regexp_extract_all(t, F.lit(lower), F.lit(0))
    each = spread(texts.select(t.alias(text))).where(t.isNotNull()).select(F.explode(F.concat(F.transform(every, lambda w: F.struct(w.alias("w"), F.lit(1).alias("n"))), F.transform(starts, lambda w: F.struct(w.alias("w"), F.lit(-1).alias("n"))))).alias("x"))
    low, small = F.lower("x.w"), F.col("x.w") == F.lower("x.w")
    counted = each.groupBy(F.pmod(F.crc32(low.cast("binary")), F.lit(CASES)).cast("int").alias("k")).agg(
        F.sum(F.when(small & (F.col("x.n") == 1), 1).otherwise(0)).alias("low"),
        F.sum(F.when(~small, F.col("x.n")).otherwise(0)).alias("mid"),  # capitals, less those that start a sentence
        F.sum(F.when(~small & (F.col("x.n") == -1), 1).otherwise(0)).alias("start"),
    )
    found = counted.toArrow()
    k, low_n, mid, start = (found.column(c).to_numpy().astype(np.int64) for c in ("k", "low", "mid", "start"))
    n, out = low_n + mid, np.zeros(CASES, dtype=np.uint8)
    share = low_n / np.maximum(n, 1)
    out[k] = np.where(n + start < 3, 0, np.where(start > 20 * n, 4, np.where(n < 3, 0, np.where(share < 0.2, 1, np.where(share < 0.5, 2, 3)))))
    return out


def fitted(texts: DataFrame, text: str, names: DataFrame, places: DataFrame, most: int = 50_000):
    """The selector as a broadcast; both reference lists must be small: one with more than ``most`` rows is refused, never cut."""
    given = [r[0] for r in names.select("name").where("name IS NOT NULL").distinct().limit(most + 1).collect()]
    listed = places.select("city", "region", "country").distinct().limit(most + 1).collect()
    if max(len(given), len(listed)) > most:
        raise ValueError(f"the lists of names and places may have {most} entries")
    known = sorted({x for r in listed for x in r if x})
    return texts.sparkSession.sparkContext.broadcast(Selector(given, known, usage=word_usage(texts, text)))


def spread(texts: DataFrame) -> DataFrame:
    """A small table over all cores, as it may lie in one file; large ones are read in parts anyway."""
    return texts.repartition(texts.sparkSession.sparkContext.defaultParallelism) if is_small(texts) else texts


def find_details(texts: DataFrame, key: str, text: str, names: DataFrame, places: DataFrame, most: int = 50_000) -> DataFrame:
    """``key, kind, found``: one row for each detail as it stands in the text, repeats included."""
    shared = fitted(texts, text, names, places, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        selector = shared.value
        for batch in batches:
            values = batch.column(1).to_pylist()
            at, kinds, found = [], [], []
            for i, spans in enumerate(selector.select(values)):
                for a, e, kind in spans:
                    at.append(i)
                    kinds.append(kind)
                    found.append(values[i][a:e])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(found, pa.string())], names=[key, "kind", "found"])

    kind = texts.schema[key].dataType.simpleString()
    return spread(texts.select(F.col(f"`{key}`"), F.col(f"`{text}`"))).mapInArrow(run, f"`{key}` {kind}, kind string, found string")


def redact_texts(texts: DataFrame, key: str, text: str, names: DataFrame, places: DataFrame, most: int = 50_000) -> DataFrame:
    """``key, redacted, details``: every text with its details replaced; null stays null."""
    shared = fitted(texts, text, names, places, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        selector = shared.value
        for batch in batches:
            values = batch.column(1).to_pylist()
            found = selector.select(values)
            clean = [None if t is None else redact(t, f) for t, f in zip(values, found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string()), pa.array([len(f) for f in found], pa.int32())], names=[key, "redacted", "details"])

    kind = texts.schema[key].dataType.simpleString()
    return spread(texts.select(F.col(f"`{key}`"), F.col(f"`{text}`"))).mapInArrow(run, f"`{key}` {kind}, redacted string, details int")
