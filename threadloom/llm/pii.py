"""Personal information inside free text (problem 5), by weak supervision.

Labelers (shape, gazetteer, left context, right context, form) vote on candidate
spans; expectation-maximisation over all vote patterns of the corpus estimates
how reliable each labeler is; a logistic span classifier trained on the resulting
probabilities makes the final decision.  The number of vote patterns is fixed by
the labelers (not by the data), so counting them is a plain distributed
aggregation and only the counts reach the driver.

Defined results: null, empty and blank fields hold nothing; a value found twice
in a block counts once; repeated rows count each; texts are read whole; an empty
table trains on the labelers' prior reliabilities and finds nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import materialize

KINDS = ("email", "id_number", "phone", "address", "name")
LABELERS = ("shape", "gazetteer", "left", "right", "form")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}

#: Common given names of the regions the texts come from, without accents.
GIVEN = (
    "adela adrian agnes alba alice amara amelie anders andre anna anselm antonio anton arthur astrid bastian beatriz benedikt bianca brigitta bruno "
    "camille carla carlos carmen caspar cecile celia charlotte clara claudia corin dagmar daniel david delphine diego dieter dmitri edvin elena elias elisa "
    "emil emma erik esther eva farah felix fernanda fernando filip florian frida gabriel georg gideon greta gustav halina hannah hector heidi "
    "helena hugo ignacio igor ilse ines ingrid irina isabel ismael ivan jakob jan javier joana joao johanna jolanta jonas jorge jose juan julia julien jurgen "
    "karin karl kasimir katarina klaus lars laura lea leon leontine lena lucas lucia luis magda manuel marco margot maria marie marisol martin mateo matilde "
    "maxim mireille mila miguel nadia natalia nicolas nikodem nina noah olga oliver oscar ottilie pablo pascal paula pedro petra pierre quirin rafael "
    "renata rosa rosalind samuel sara silvia simon sofia soren soraya stefan svetlana tatiana teresa theo thomas tobias ursula valentin vera victor viktor "
    "wilma xavier yara yusuf yvonne zelda"
).split()
#: Labels that end host names in examples and in public.
_TLD = {"com", "org", "net", "edu", "gov", "io", "dev", "de", "fr", "es", "pt", "br", "ru", "jp", "cn", "uk", "eu", "info", "example", "test", "invalid", "localhost"}
_CUES = {
    "email": r"(?:mailto:|e-?mail|contact|account|konto|compte|conta|cuenta|login|user=|reply-to|cc|to|at|from|for|a|à|an|em|para|на|到|<|\(|[\"'])\s*[:=]?\s*[\"'(<]?$",
    "phone": r"(?:phone|tel|call|number|desk|mobile|pager|try|contact|fax|text|llám|ligue|appelle|erreich|unter|kontakt|телефон|номер|позвони|電話|电话|;|[\"'])\D{0,14}$",
    "id_number": r"(?:ssn|passport|\bid\b|id number|national|dni|docum|identit|ausweis|kenn|tax|steuer|social security|citizen)\W*(?:\w+\W+){0,3}$",
    "address": r"(?:\bto|\bat|\bin|\bfrom|\blives|\bliving|moved|address|visit:?|\ban|\bau|\bna|\bnach|\ben|\bin der|\ba|para|;|[\"'])\s*$",
    "name": r"(?:\b(?:dr|mr|mrs|ms|frau|herr|m|mme|sr|sra|prof)\.?|\b(?:ask|ping|tell|thank|per|by|with|for|from|to|of|owner|assignee|reviewer|author|user|name|a|à|de|von|an|cc)|[=:;(\"'>])[\s\"'=:(]*$",
}
_RIGHT = {
    "email": r"\s*(?:[\s.,;:)\]>\"'!?、。]|$|[^\x00-\x7f])",
    "phone": r"\s*(?:[.,;:)\]\"'!?]|ext\b|$|\s|[^\x00-\x7f])",
    "id_number": r"\s*(?:[.,;:)\]\"'!?]|$|\s)",
    "address": r"\s*(?:[.,;\"'!?)]|$|[a-z]+\b|\d{1,2}\s?[ap]m)",
    "name": r"(?:[’']s\b|\s*[.,;:)\]\"'!?<]|\s+[^\W\d_]*[a-zà-ÿ]\b|$|\n)",
}
_CUE_RE = {k: re.compile(v, re.I) for k, v in _CUES.items()}
_RIGHT_RE = {k: re.compile(v, re.I) for k, v in _RIGHT.items()}
#: What marks numbers of machines.
_TECHNICAL = re.compile(r"(?:version|build|sha|port|line|issue|ticket|pid|row|commit|checksum|offset|serial|order|invoice|tag|release|size|bytes|port)\s*[#:=]?\s*$", re.I)

_START = r"(?:(?<=\\[nrt])|(?<![A-Za-z0-9._%+\-\\]))"
_EMAIL = re.compile(_START + r"[A-Za-z0-9_%+\-](?:[A-Za-z0-9._%+\-]*[A-Za-z0-9_%+\-])?@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
_DOT = r"(?:\.| ?[\[(]dot[\])] ?| dot )"
_OBFUSCATED = re.compile(
    _START + r"[A-Za-z0-9_%+\-]+(?:" + _DOT + r"[A-Za-z0-9_%+\-]+)*(?: ?[\[(](?:at|arroba)[\])] ?| at (?=[A-Za-z0-9-]+ dot ))[A-Za-z0-9-]+(?:" + _DOT + r"[A-Za-z0-9-]+)+\b(?! at | ?[\[(]at)",
    re.I,
)
_LEFT_EDGE, _RIGHT_EDGE = r"(?<![A-Za-z0-9_.+/:\-])", r"(?![A-Za-z0-9_])(?![.\-/:]\d)"
#: Published forms of national telephone numbers, most specific first.
_PHONES = {
    "nanp": r"(?:(?:\+1|001|1)[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}|\+1\d{10}",
    "uk": r"\+44 ?\(?0?\)? ?\d{2,4} ?\d{3,4} ?\d{3,4}|0\d{2} \d{4} \d{4}|0\d{4} \d{6}",
    "de": r"(?:\+49|0049)[ /]?\(?0?\d{2,4}\)?[ /]?\d{4,9}(?:[ \-]\d{1,4})?|\(0\d{2,4}\) ?\d{4,8}(?:-\d{1,4})?|0\d{2,4}[ /]\d{4,8}(?:[ \-]\d{2,4})?",
    "es": r"\(?\+34\)?[ \-]?\d{3}[ \-]?\d{2,3}[ \-]?\d{2,3}(?:[ \-]?\d{2})?|\d{3}[ \-]\d{2}[ \-]\d{2}[ \-]\d{2}|0034[ \-]\d{3}(?:[ \-]\d{2,3}){2,3}",
    "fr": r"(?:(?:\+33|0033) ?(?:\(0\) ?)?\d|0\d)(?:[ .\-]?\d\d){4}",
    "br": r"(?:\+?55 ?)?\(?\d{2}\)? \d{4,5}-\d{4}",
    "ru": r"(?:\+7|8)[ \-]?\(?\d{3}\)?[ \-]?\d{3}[ \-]?\d\d[ \-]?\d\d",
    "jp": r"(?:\+81[ \-]?\d{1,4}|0\d{1,4})[\-]\d{2,4}-\d{4}|\+81 ?\d{1,2} ?\d{4} ?\d{4}",
    "cn": r"(?:(?:\+|00)86[ \-]?)?1\d{2}[ \-]\d{4}[ \-]\d{4}|(?:\+|00)86[ \-]?\d{11}",
    "other": r"\+\d[\d ().\-]{7,16}\d",
}
_PHONE = re.compile(_LEFT_EDGE + "(?:" + "|".join(f"(?P<{k}>{v})" for k, v in _PHONES.items()) + ")" + _RIGHT_EDGE)
#: Forms of numbers by which authorities know a person.
_IDS = {
    "ssn": r"\d{3}[ \-]\d{2}[ \-]\d{4}",
    "nino": r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]",
    "tax": r"\d{2} \d{3} \d{3} \d{3}",
    "cpf": r"\d{3}\.\d{3}\.\d{3}-\d{2}",
    "dni": r"\d{8}-?[A-Z]|\d{2}\.\d{3}\.\d{3}-[A-Z]",
    "passport": r"[A-Z]\d{8}",
    "insee": r"[12] \d{2} \d{2} \d{2} \d{3} \d{3}(?: \d{2})?",
    "snils": r"\d{3}-\d{3}-\d{3} \d{2}",
}
#: Bare digits behind a word that says what they are.
_LABELLED_ID = re.compile(r"\b(?:ssn|social security(?: number)?|passport(?: number)?|national id|tax id|dni|nif|cpf|снилс|инн|паспорт)\W{0,4}(?:(?:is|number|no|№)\W{0,3})?(\d{6,12}|[A-Z]{1,2}\d{6,9}[A-Z]?)(?![A-Za-z0-9_.\-])", re.I)
_LABELLED_PHONE = re.compile(r"\b(?:phone|telephone|tel|mobile|cell|whatsapp|call (?:me|us)?(?: at| on)?|ring|telefon|teléfono|telefone|téléphone|телефон)\W{0,4}(?:(?:is|number|no)\W{0,3})?(\+?\d{9,13})(?![A-Za-z0-9_.\-])", re.I)
_LONG_NUMBER = re.compile(r"\d{6}")
#: International bank account numbers, whose groups look like telephone numbers.
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_ID = re.compile(_LEFT_EDGE + "(?:" + "|".join(f"(?P<{k}>{v})" for k, v in _IDS.items()) + ")" + _RIGHT_EDGE)
_WORD = r"[^\W\d_]+(?:[’'\-][^\W\d_]+)*"
_STREETS = {
    "en": r"\d{1,5}[A-Z]?,? (?:(?:Old|New|North|South|East|West|Upper|Lower|N\.|S\.|E\.|W\.) )*(?:[A-Z][a-z]+ ){1,2}(?:Street|St\.|St\b|Road|Rd\.?|Avenue|Ave\b\.?|Drive|Dr\b\.?|Lane|Ln\b\.?|Way|Court|Ct\b\.?|Boulevard|Blvd\.?|Place|Pl\b\.?|Square|Terrace|Crescent|Close)",
    "de": r"(?:(?:Alte|Neue|Am|An der|Große|Kleine) )?[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|str\.|weg|allee|platz|gasse|ring|damm|ufer)(?: |-)\d{1,4} ?[a-z]?\b",
    "fr": r"\d{1,4}(?: ?(?:bis|ter|quater|[A-D]))?,? (?:rue|avenue|chemin|boulevard|place|allée|impasse|route|quai|cours|av\.|bd)\b (?:(?:de la|de l[’']|du|des|de|d[’']) ?)?[A-ZÀ-Ý][\w’'\-]+(?: [A-ZÀ-Ý][\w’'\-]+)?",
    "ib": r"(?:(?:Calle|Avenida|Avda\.?|Paseo|Plaza|Camino|Carretera|Rua|Travessa|Alameda|Praça|Largo|Estrada)\b|C/|R\.|Av\.|Pza\.) ?(?:(?:de la|del|de|da|do|dos|das) )?[A-ZÀ-Ý][\w’'\-]+(?: [A-ZÀ-Ý][\w’'\-]+)?,? (?:n[.º°o]+ ?)?\d{1,5}(?: ?[A-Za-z]\b)?",
    "it": r"(?:Via|Viale|Piazza|Piazzale|Corso|Largo|Vicolo)\b (?:(?:della|delle|dei|degli|del|di|dell[’'])[ ]?)?[A-ZÀ-Ý][\w’'\-]+(?: [A-ZÀ-Ý][\w’'\-]+)?,? \d{1,4}(?:/?[A-Za-z]\b)?",
    "nl": r"[A-Z][a-z]+(?:straat|laan|gracht|plein|kade|dijk|singel|weg) \d{1,4} ?[a-z]?\b",
    "ru": r"(?:ул\.|улица|пр\.|проспект|пер\.|переулок) ?[А-ЯЁ][\w\-]+,? (?:д\. ?|дом )?\d{1,4}[а-я]?",
}
_ADDRESS = re.compile(r"(?<![A-Za-z0-9_./\-])(?:" + "|".join(f"(?P<{k}>{v})" for k, v in _STREETS.items()) + r")(?![A-Za-z0-9_])")
_CAPS_TAIL = re.compile(r"(?: [A-Z]\.?){0,2}$")
_GIVEN_RE = re.compile(r"(?<![\w@.\-/])(?:" + "|".join(sorted(GIVEN, key=len, reverse=True)) + r")(?![\w@/])", re.I)
_AFTER = re.compile(r"((?: [A-Z]\.){0,2}) (" + r"[^\W\d_]+(?:-[^\W\d_]+)*" + r")")
_BEFORE = re.compile(r"([^\W\d_]+(?:-[^\W\d_]+)*), $")
_REST = re.compile(r"(?: [A-Z]\.){0,2}")
_INITIAL = re.compile(r"(?<![\w.@/\-])[A-Z]\. (?:[A-Z]\. )?(?:[A-Z][^\W\d_]*[a-z][^\W\d_]*|[A-Z]{3,})(?:-[A-Z][^\W\d_]+)?(?![\w@/])")
_FIELD = re.compile(r"(?:\"(?:assignee|name|owner|author|reviewer|reporter|customer)\": ?\"|VALUES \(\d+, ?'|(?:^|[\"\n])\d+;)([^\W\d_]+(?: [A-Z]\.)? [^\W\d_]+(?:-[^\W\d_]+)*|[^\W\d_]+(?:-[^\W\d_]+)*, [^\W\d_]+(?: [A-Z]\.)?)(?=[\"';])")
_STOP = set("the this that then there main old new north south east west from for and not but api get post error warn sha select insert values into with at on in by we you".split())


#: Titles and relations that a name follows, whatever the name.
_TITLE = r"(?:Dr|Mr|Mrs|Ms|Miss|Prof|Sir|Frau|Herr|Mme|Mlle|Monsieur|Madame|Sr|Sra|Srta|Dra|Señora?|Senhora?|Dona|Don|Sig|Signora?|Mevrouw|Meneer|Pan|Pani)\.?"
_RELATION = (
    r"(?:(?:[Aa]sk|[Tt]ell|[Pp]ing|[Cc]ontact|[Ee]mail|[Mm]eet|[Tt]hank|[Nn]otify|[Ii]nvite|[Aa]ssigned to|[Rr]eported by|[Ww]ritten by|[Rr]eviewed by|[Ss]igned by|[Aa]pproved by|[Oo]wned by|[Rr]egards,|[Ss]incerely,|[Mm]y name is|[Tt]his is|[Ii] am"
    r"|[Aa]uthor|[Oo]wner|[Aa]ssignee|[Rr]eviewer|[Nn]ame|[Cc]ustomer|[Pp]atient|[Ee]mployee|[Nn]ombre|[Nn]om|[Nn]ome|[Ff]rag(?:e|t)?|[Pp]regunta a|[Dd]emande à|[Pp]ergunte a) ?:?)"
)
_PART = r"[A-ZÀ-ÖØ-ÞŠŽĆČĐŁŃŚŹŻ][^\W\d_]*[a-zà-öø-ÿāăąćčďđēęěğīłńňőřśšťūůűźżž][^\W\d_]*(?:[-’'][A-ZÀ-ÖØ-Þ]?[^\W\d_]+)*"
_PARTICLE = r"(?:(?:[Aa]l|[Ee]l|[Bb]en|[Bb]in|[Dd]e(?: la)?|[Dd]el|[Dd]i|[Dd]a|[Dd]os|[Dd]u|[Vv]an(?: de[rn]?)?|[Vv]on|[Zz]u)[ -])?"
_FULL = rf"{_PART}(?: [A-Z]\.)?(?: {_PARTICLE}{_PART}){{1,2}}"
_TITLED = re.compile(rf"(?<![\w.]){_TITLE} ({_FULL})(?![\w@/])")
_RELATED = re.compile(rf"(?<![\w.@/-]){_RELATION} ({_FULL})(?![\w@/(])(?!\.\w)")
#: Family names and patronymics in Cyrillic letters have endings of their own, whatever their case.
_SLAVIC_ENDING = r"(?:[оеё]в|[иы]н|ск[иоа]|цк[иоа]|енк|ук|юк)(?:а|у|ым|ом|ой|е|й|я|ю|ого|ому|их|им|о)?"
_SLAVIC = re.compile(rf"(?<![\w])([А-ЯЁІЇЄҐ][а-яёіїєґ]+(?: [А-ЯЁ][а-яё]+(?:вич|вн)[а-яё]{{0,2}})? [А-ЯЁІЇЄҐ][а-яёіїєґ]{{1,12}}?{_SLAVIC_ENDING})(?![\w])")
#: The commonest Chinese family names; a given name of one or two characters follows.  One of them with a title or a word of address is a name.
_HAN_FAMILY = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"
_HAN_NAME = re.compile(rf"([{_HAN_FAMILY}][\u4e00-\u9fff]{{1,2}}?)(?=先生|女士|小姐|老师|经理|医生|博士|教授|同学|总监|工程师)")
_HAN_CALLED = re.compile(rf"(?:我叫|名叫|姓名[是为：: ]{{0,2}}|联系人[是为：: ]{{0,2}}|作者[是为：: ]{{0,2}}|负责人[是为：: ]{{0,2}})([{_HAN_FAMILY}][\u4e00-\u9fff]{{1,2}})(?![\u4e00-\u9fff])")
_KANA_NAME = re.compile(r"(?<![\u4e00-\u9fff])([\u4e00-\u9fff]{2,3}[ 　][\u4e00-\u9fff]{1,3})(?=さん|様|氏|先生|君)")


#: Words one of which a title or a relation holds; a text without any is passed over at once.
_TITLE_WORDS = ("Dr", "Mr", "Ms", "Miss", "Prof", "Sir", "Frau", "Herr", "Mme", "Mlle", "Monsieur", "Madame", "Sr", "Señor", "Senhor", "Don", "Sig", "Mevrouw", "Meneer", "Pan")
_RELATION_WORDS = ("sk ", "ell ", "ing ", "act ", "ail ", "eet ", "ank ", "ify ", "ite ", "ed to ", "ed by ", "ten by ", "ards,", "rely,", "is is ", " am ", "uthor", "wner", "ignee", "iewer", "ame", "omer", "ient", "oyee", "ombre", "om ", "om:", "ome", "rag", "unta a ", "ande à ", "unte a ")
_CAPITALS = re.compile(r"[A-ZÀ-Þ][^\W\d_]+(?: [A-Z]\.)? (?:[A-Za-z]{2,3}[ -])?[A-ZÀ-Þ][^\W\d_]")


def _by_context(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, form) of names that their surroundings give away, whatever they are."""
    paired = _CAPITALS.search(text)
    for pattern, words, form in ((_TITLED, _TITLE_WORDS, "titled"), (_RELATED, _RELATION_WORDS, "related")):
        if not paired or not any(w in text for w in words):
            continue
        for m in pattern.finditer(text):
            if not any(w.lower().strip(".") in _STOP for w in m[1].split()):
                yield *m.span(1), form
    if not text.isascii():
        for pattern, form in ((_SLAVIC, "slavic"), (_HAN_NAME, "han"), (_HAN_CALLED, "han"), (_KANA_NAME, "han")):
            for m in pattern.finditer(text):
                yield *m.span(1), form


def _folding() -> dict[int, str]:
    out = {ord("ø"): "o", ord("Ø"): "O", ord("ł"): "l", ord("Ł"): "L"}
    for o in range(0xC0, 0x180):
        base = unicodedata.normalize("NFD", chr(o))[0]
        if base.isascii() and base.isalpha():
            out.setdefault(o, base)
    return out


_FOLD = _folding()


def _shape(word: str) -> str:
    letters = word.replace("-", "").replace("’", "")
    if letters.isupper():
        return "U" if len(letters) > 1 else "I"
    return "l" if letters.islower() else "T" if word[:1].isupper() else "m"


def _family(word: str) -> bool:
    """Whether a word can be a family name: three letters or more, and no word that only joins others."""
    return len(word) >= 3 and word.lower() not in _STOP and any(c.isalpha() for c in word)


def _names(text: str, folded: str) -> Iterator[tuple[int, int, str, int, int]]:
    """(start, end, form, shape vote, gazetteer vote) of name candidates."""
    taken: set[int] = set()
    for m in _GIVEN_RE.finditer(folded):
        a, b = m.span()
        if b - a < 3 or a in taken:
            continue
        s = _shape(text[a:b])
        rev = _BEFORE.search(text, max(0, a - 60), a)
        after = _AFTER.match(text, b)
        forward = after and _shape(after[2]) == s and s != "m" and after[2].lower() not in _STOP
        if rev and _shape(rev[1]) == s and rev[1].lower() not in _STOP and (_family(rev[1]) or not forward):
            rest = _REST.match(text, b)
            taken.update(range(rev.start(1), rest.end()))
            yield rev.start(1), rest.end(), "reversed", 1 if _family(rev[1]) else -1 if s == "l" else 0, 1
        elif forward:
            taken.update(range(a, after.end()))
            yield a, after.end(), "upper" if s == "U" else "lower" if s == "l" else "title", 1 if _family(after[2]) else -1 if s == "l" else 0, 1
    for m in _INITIAL.finditer(text):
        if m.start() not in taken and (m.end() - 1) not in taken:
            last = m[0].rpartition(" ")[2]
            if last.lower() not in _STOP:
                taken.update(range(*m.span()))
                yield m.start(), m.end(), "initial", 1 if _family(last) else 0, 0
    for a, b, form in _by_context(text):
        if not taken & set(range(a, b)):
            taken.update(range(a, b))
            yield a, b, form, 1, 0
    for m in _FIELD.finditer(text):
        a, b = m.span(1)
        if not taken & {a, b - 1}:
            taken.update(range(a, b))
            last = m[1].split(",")[0].rpartition(" ")[2]
            yield a, b, "field", 1 if _family(last) else 0, 0


def candidates(text: str) -> list[tuple[int, int, str, str, tuple[int, ...]]]:
    """(start, end, kind, form, votes) of the candidate spans, not overlapping, by priority of kind."""
    raw: list[tuple[int, int, str, str, int, int]] = []
    if "@" in text:
        raw += [(*m.span(), "email", "plain", 1, 1 if m[0].rpartition(".")[2].lower() in _TLD else -1) for m in _EMAIL.finditer(text)]
    low = text.lower()
    if "(at)" in low or "[at]" in low or " dot " in low or "arroba" in low:
        for m in _OBFUSCATED.finditer(text):
            raw.append((*m.span(), "email", "spelled", 1, 1 if re.split(r"[.\s\]\)]", m[0])[-1].lower() in _TLD else -1))
    digits = any(c.isdigit() for c in text)
    if digits:
        raw += [(*m.span(), "id_number", m.lastgroup, 1, 0) for m in _ID.finditer(text)]
        if _LONG_NUMBER.search(text):
            raw += [(*m.span(1), "id_number", "labelled", 1, 1) for m in _LABELLED_ID.finditer(text)]
            raw += [(*m.span(1), "phone", "labelled", 1, 1) for m in _LABELLED_PHONE.finditer(text)]
        raw += [(*m.span(), "phone", m.lastgroup, 1 if m.lastgroup != "other" else 0, 1 if m[0][0] in "+(0" or m.lastgroup == "nanp" else 0) for m in _PHONE.finditer(text)]
        raw += [(*m.span(), "address", m.lastgroup, 1, 1) for m in _ADDRESS.finditer(text)]
    raw += [(a, b, "name", form, sv, gv) for a, b, form, sv, gv in _names(text, text.translate(_FOLD))]
    rank = {k: i for i, k in enumerate(KINDS)}
    out: list[tuple[int, int, str, str, tuple[int, ...]]] = []
    used: list[tuple[int, int]] = [m.span() for m in _IBAN.finditer(text)] if raw and digits else []
    for a, b, kind, form, shape, gaz in sorted(raw, key=lambda x: (rank[x[2]], x[0] - x[1], x[0])):
        if any(a < d and c < b for c, d in used):
            continue
        used.append((a, b))
        left, right = text[max(0, a - 40) : a], text[b : b + 24]
        lv = 1 if _CUE_RE[kind].search(left) else 0
        rv = 1 if _RIGHT_RE[kind].match(right) else 0
        fv = 0
        if kind == "email":
            if text[a:b].lower().startswith("git@") or right[:1] == ":" and right[1:2].isalnum() or left.endswith(("ssh://", "/")):
                fv, rv = -1, -1
        elif kind in ("phone", "id_number"):
            if _TECHNICAL.search(left):
                lv = -1
            if re.match(r"\s?(?:ms|kb|mb|gb|%|px|bytes)\b", right, re.I):
                rv = -1
            if form == "labelled":
                lv = 1
            n = sum(c.isdigit() for c in text[a:b])
            fv = (1 if 9 <= n <= 14 else -1) if kind == "phone" else (1 if n >= 6 else -1)
        elif kind == "name":
            if re.search(r"[/@_]$", left) or re.match(r"[/@_]|\.\w|\(", right):
                fv = -1
            elif form in ("titled", "related", "slavic", "han"):
                lv = fv = 1
            elif form in ("title", "upper", "reversed", "initial", "field"):
                fv = 1
        out.append((a, b, kind, form, (shape, gaz, lv, rv, fv)))
    return out


# ---- label model and classifier (driver side, on pattern counts) -------------


#: P(vote | class) to start from, for the votes -1, 0 and 1: false and true spans.
_START_TABLE = np.array([[0.45, 0.25, 0.30], [0.02, 0.28, 0.70]])


def label_model(votes: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(vote tables of the labelers, probability of each pattern) by EM (Dawid and Skene).

    A table holds P(vote | class); it starts from and is smoothed towards
    _START_TABLE, so that the classes can't change places.
    """
    k = votes.shape[1]
    tables, prior = np.repeat(_START_TABLE[None], k, 0), 0.7
    one_hot = votes[:, :, None] == np.array([-1, 0, 1])  # pattern, labeler, vote
    p = np.full(len(votes), 0.5)
    for _ in range(rounds):
        log = np.einsum("njv,jcv->nc", one_hot, np.log(tables))
        p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1] - np.log(prior / (1 - prior)), -500, 500)))
        for c, q in enumerate((1 - p, p)):
            counts = np.einsum("n,njv->jv", weight * q, one_hot) + 20 * _START_TABLE[c]
            tables[:, c] = counts / counts.sum(1, keepdims=True)
        prior = float(np.clip((weight * p).sum() / max(weight.sum(), 1e-9), 0.05, 0.95))
    return tables, p


def _features(kind: str, form: str, votes: tuple[int, ...]) -> list[str]:
    return [f"{kind}", f"{kind}|{form}", *(f"{kind}|{n}={v}" for n, v in zip(LABELERS, votes))]


def train(patterns: list[tuple[str, str, tuple[int, ...], int]], rounds: int = 300, rate: float = 0.5, l2: float = 1e-3) -> tuple[dict[str, float], dict]:
    """(weights of the span classifier, vote tables of the labelers by kind) from counted patterns (kind, form, votes, n)."""
    names: dict[str, int] = {}
    rows, target, weight, reliability = [], [], [], {}
    for kind in KINDS:
        own = [x for x in patterns if x[0] == kind]
        if not own:
            continue
        v, w = np.array([x[2] for x in own], float), np.array([x[3] for x in own], float)
        tables, p = label_model(v, w)
        reliability[kind] = dict(zip(LABELERS, tables.round(4).tolist()))
        for x, q in zip(own, p):
            rows.append([names.setdefault(f, len(names)) for f in _features(*x[:3])])
            target.append(q)
            weight.append(np.log1p(x[3]))
    if not rows:
        return {}, {}
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, r] = 1
    y, w = np.array(target), np.array(weight)
    w = w / w.sum()
    beta = np.zeros(len(names))
    step = np.zeros(len(names))
    for _ in range(rounds):
        g = x.T @ (w * (1 / (1 + np.exp(-x @ beta)) - y)) + l2 * beta
        step = 0.9 * step + g
        beta -= rate * step
    return {n: float(beta[i]) for n, i in names.items()}, reliability


def score(weights: dict[str, float], kind: str, form: str, votes: tuple[int, ...]) -> float:
    return 1 / (1 + np.exp(-sum(weights.get(f, 0.0) for f in _features(kind, form, votes))))


# ---- distributed parts -------------------------------------------------------


def block_fields(records: DataFrame) -> DataFrame:
    """(rec_id, block_no, field, value): the texts, tool inputs and tool results of all blocks."""
    return records.select("rec_id", F.posexplode("message.content").alias("block_no", "b")).select(
        "rec_id", F.col("block_no").cast("long"),
        F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"b.{f}").alias("value")) for f in ("text", "input", "content")))),
    ).where("value is not null and value <> ''")


_KEY = ["rec_id", "block_no", "field", "text_hash"]
_SPANS = "rec_id long, block_no long, field string, text_hash long, start int, end int, kind string, form string, votes string, value string"


def spans(fields: DataFrame) -> DataFrame:
    """The candidate spans of all fields, where they stand and the labelers' votes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (r, n, f, h, a, b, kind, form, ",".join(map(str, votes)), v[a:b])
                for r, n, f, h, v in zip(pdf.rec_id, pdf.block_no, pdf.field, pdf.text_hash, pdf.value)
                for a, b, kind, form, votes in candidates(v)
            ]
            yield pd.DataFrame(rows, columns=[*_KEY, "start", "end", "kind", "form", "votes", "value"])

    return fields.withColumn("text_hash", F.xxhash64("value")).mapInPandas(run, _SPANS)


def fit(found: DataFrame) -> tuple[dict[str, float], dict]:
    """Train on the counted vote patterns of all candidate spans."""
    counted = found.groupBy("kind", "form", "votes").count().collect()
    return train([(r["kind"], r["form"], tuple(map(int, r["votes"].split(","))), r["count"]) for r in sorted(counted)])


def decide(found: DataFrame, weights: dict[str, float], least: float = 0.5) -> DataFrame:
    """The spans the classifier takes for personal information."""
    logit = F.lit(0.0)
    if weights:
        table = F.create_map(*(F.lit(x) for kv in sorted(weights.items()) for x in kv))
        get = lambda k: F.coalesce(table[k], F.lit(0.0))
        votes = F.split("votes", ",")
        logit = get(F.col("kind")) + get(F.concat_ws("|", "kind", "form"))
        for j, n in enumerate(LABELERS):
            logit = logit + get(F.concat(F.col("kind"), F.lit(f"|{n}="), votes[j]))
    return found.where(logit >= float(np.log(least / (1 - least)))) if weights else found.where("false")


def find(records: DataFrame, least: float = 0.5) -> DataFrame:
    """(rec_id, block_no, pii_kind, pii_value), one row per distinct value of a block."""
    found = materialize(spans(block_fields(records)), "pii-spans")
    weights, _ = fit(found)
    return decide(found, weights, least).select("rec_id", "block_no", F.col("kind").alias("pii_kind"), F.col("value").alias("pii_value")).distinct()


def redact(records: DataFrame, least: float = 0.5) -> DataFrame:
    """(rec_id, block_no, field, value, n_replaced): every field with typed placeholders for the spans found.

    Texts are searched once; the spans that are decided on come back by their place.
    """
    fields = block_fields(records)
    found = materialize(spans(fields), "pii-spans")
    weights, _ = fit(found)
    markers = F.create_map(*(F.lit(x) for kv in PLACEHOLDER.items() for x in kv))
    # A field's spans don't overlap, so they are replaced from its end to its start.
    own = decide(found, weights, least).groupBy(*_KEY).agg(F.reverse(F.array_sort(F.collect_set(F.struct("start", "end", markers[F.col("kind")].alias("marker"))))).alias("spans"))
    put = lambda text, s: F.concat(F.left(text, s["start"]), s["marker"], F.substr(text, s["end"] + 1))
    joined = fields.withColumn("text_hash", F.xxhash64("value")).join(own, _KEY, "left")
    value = F.when(F.col("spans").isNull(), F.col("value")).otherwise(F.aggregate("spans", F.col("value"), put))
    return joined.select("rec_id", "block_no", "field", value.alias("value"), F.coalesce(F.size("spans"), F.lit(0)).alias("n_replaced"))
