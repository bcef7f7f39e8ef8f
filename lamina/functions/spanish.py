"""Spanish words for full-text search: stop words, and stems by the published suffix-stripping algorithm for Spanish.

A stem is found in three steps (attached pronouns, suffixes of nouns or else endings of verbs, what is left of the ending) that only look
at suffixes within regions of the word: ``rv`` and the ends after the first and the second consonant that follows a vowel.
Each step is a rule on the longest suffix of a list.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cache

VOWELS = "aeiouáéíóúü"
#: Suffixes by what is done with them.
PRONOUNS = ("me", "se", "sela", "selo", "selas", "selos", "la", "le", "lo", "las", "les", "los", "nos")
BEFORE_PRONOUNS = ("iéndo", "ándo", "ár", "ér", "ír", "ando", "iendo", "ar", "er", "ir", "yendo")
PLAIN = ("anza", "anzas", "ico", "ica", "icos", "icas", "ismo", "ismos", "able", "ables", "ible", "ibles", "ista", "istas", "oso", "osa", "osos", "osas", "amiento", "amientos", "imiento", "imientos")
AFTER_IC = ("adora", "ador", "ación", "adoras", "adores", "aciones", "acion", "ante", "antes", "ancia", "ancias")
REPLACED = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente", "encias": "ente"}
#: Suffix: what may go with it if it stands before it.
WITH_MORE = {"mente": ("ante", "able", "ible"), "idad": ("abil", "ic", "iv"), "idades": ("abil", "ic", "iv"), "iva": ("at",), "ivo": ("at",), "ivas": ("at",), "ivos": ("at",)}
Y_VERBS = ("ya", "ye", "yan", "yen", "yeron", "yendo", "yo", "yó", "yas", "yes", "yais", "yamos")
VERBS_GU = ("en", "es", "éis", "emos")
VERBS = tuple(
    """arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré
    aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais
    aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos""".split()
)
#: Stop words that no rule makes.
STOP_BASE = frozenset(
    """de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni
    contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho quienes nada muchos cual poco ella estas algunas algo nosotros mi mis tú te ti tu tus ellas nosotras vosotros
    vosotras os mío mía míos mías tuyo tuya tuyos tuyas suyo suya suyos suyas nuestro nuestra nuestros nuestras vuestro vuestra vuestros vuestras esos esas
    es soy eres somos sois he has ha hemos habéis han hubo había fui fue fuiste fuimos fuisteis fueron sentid tened""".split()
)
#: Endings of auxiliaries by tense, and the stems that take them.
FUTURE, CONDITIONAL = "é ás á emos éis án".split(), "ía ías íamos íais ían".split()
PAST_SUBJUNCTIVE = [f"{a}{b}" for a in ("ra", "se") for b in ("", "s", "is", "n")]
AUXILIARIES = {
    "est": ["oy", "ás", "á", "amos", "áis", "án", "é", "és", "emos", "éis", "én", "aba", "abas", "ábamos", "abais", "aban", "uve", "uviste", "uvo", "uvimos", "uvisteis", "uvieron", "uviéramos", "uviésemos", "ando", "ado", "ada", "ados", "adas", "ad"],
    "h": ["aya", "ayas", "ayamos", "ayáis", "ayan", "abía", "abías", "abíamos", "abíais", "abían", "ube", "ubiste", "ubimos", "ubisteis", "ubieron", "ubiéramos", "ubiésemos", "abiendo", "abido", "abida", "abidos", "abidas"],
    "s": ["on", "ea", "eas", "eamos", "eáis", "ean", "iendo", "ido"],
    "e": ["ra", "ras", "ramos", "rais", "ran"],
    "é": ["ramos"],
    "fu": ["éramos", "ésemos"],
    "t": ["engo", "ienes", "iene", "enemos", "enéis", "ienen", "enga", "engas", "engamos", "engáis", "engan", "enía", "enías", "eníamos", "eníais", "enían", "uve", "uviste", "uvo", "uvimos", "uvisteis", "uvieron", "uviéramos", "uviésemos", "eniendo", "enido", "enida", "enidos", "enidas"],
    "sint": ["iendo"],
    "sent": ["ido", "ida", "idos", "idas"],
    "sient": ["e"],
} | {stem: [*FUTURE, *CONDITIONAL] for stem in ("estar", "habr", "ser", "tendr")} | {stem: PAST_SUBJUNCTIVE for stem in ("estuvie", "hubie", "fue", "tuvie")}


@cache
def stop_words() -> frozenset[str]:
    return STOP_BASE | {stem + end for stem, ends in AUXILIARIES.items() for end in ends}


def regions(word: str) -> tuple[int, int, int]:
    """Where rv, r1 and r2 begin."""
    after = lambda start: (m.end() if (m := re.compile(f"[^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]").match(word, start)) else len(word))
    r1 = after(0)
    if re.match(f".[^{VOWELS}]", word):
        rv = re.match(f"..[^{VOWELS}]*[{VOWELS}]", word)
    elif re.match(f"[{VOWELS}]{{2}}", word):
        rv = re.match(f"..[{VOWELS}]*[^{VOWELS}]", word)
    else:
        rv = re.match("...", word)
    return rv.end() if rv else len(word), r1, after(r1)


def longest(word: str, suffixes: Iterable[str], start: int = 0) -> str:
    """The longest of ``suffixes`` that the word ends with, from ``start`` on; empty if none."""
    return max((s for s in suffixes if word.endswith(s) and len(word) - len(s) >= start), key=len, default="")


def without(word: str, suffixes: Iterable[str], start: int) -> str:
    """Without its longest such suffix, if that lies wholly behind ``start``."""
    s = longest(word, suffixes)
    return word[: len(word) - len(s)] if s and len(word) - len(s) >= start else word


def without_pronoun(word: str, rv: int) -> str:
    pronoun = longest(word, PRONOUNS)
    base = word[: len(word) - len(pronoun)]
    verb = longest(base, BEFORE_PRONOUNS)
    if not pronoun or not verb or len(base) - len(verb) < rv or verb == "yendo" and not base.endswith("uyendo"):
        return word
    return base[: len(base) - len(verb)] + verb.translate(PLAIN_VOWELS)


PLAIN_VOWELS = str.maketrans("áéíóú", "aeiou")
NOUNS = (*PLAIN, *AFTER_IC, *REPLACED, "amente", *WITH_MORE)


def without_noun_suffix(word: str, r1: int, r2: int) -> str:
    s = longest(word, NOUNS)
    base = word[: len(word) - len(s)]
    if not s or len(base) < (r1 if s == "amente" else r2):
        return word
    if s in REPLACED:
        return base + REPLACED[s]
    if s in AFTER_IC:
        return without(base, ("ic",), r2)
    if s in WITH_MORE:
        return without(base, WITH_MORE[s], r2)
    if s == "amente":
        short = without(base, ("iv", "os", "ic", "ad"), r2)
        return without(short, ("at",), r2) if short != base and base.endswith("iv") else short
    return base


def without_verb_ending(word: str, rv: int) -> str:
    y = longest(word, Y_VERBS, rv)
    if y and word[: len(word) - len(y)].endswith("u"):
        return word[: len(word) - len(y)]
    s = longest(word, (*VERBS_GU, *VERBS), rv)
    base = word[: len(word) - len(s)]
    return base[:-1] if s in VERBS_GU and base.endswith("gu") else base


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    rv, r1, r2 = regions(word)
    word = without_pronoun(word, rv)
    short = without_noun_suffix(word, r1, r2)
    word = short if short != word else without_verb_ending(word, rv)
    s = longest(word, ("os", "a", "o", "á", "í", "ó", "e", "é"))
    if s and len(word) - len(s) >= rv:
        word = word[: len(word) - len(s)]
        if s in "eé" and word.endswith("gu") and len(word) - 1 >= rv:
            word = word[:-1]
    return word.translate(PLAIN_VOWELS)


def lexeme(word: str) -> str | None:
    """What a lower-case word is searched as; None for a stop word."""
    return None if word in stop_words() else stem(word)
