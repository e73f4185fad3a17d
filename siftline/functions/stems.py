"""Word stems: the Snowball algorithms for English (Porter2) and Spanish, and the shorter of both.

Stems are made once for each distinct word and joined to what holds the words,
so Python sees the vocabulary and not the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The letters of words that have stems.
LETTERS = re.compile(r"[a-záéíóúñü]+")

EN_VOWELS, ES_VOWELS = "aeiouy", "aeiouáéíóúü"
ACUTE = str.maketrans("áéíóú", "aeiou")

# Fixed values of the published English algorithm: whole words, endings by step and what replaces them.
EN_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
EN_AFTER_PLURAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
EN_STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive",
    "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
EN_STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
EN_STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")

# Fixed values of the published Spanish algorithm: pronouns and endings by step.
ES_PRONOUNS = ("selas", "selos", "sela", "selo", "las", "les", "los", "nos", "me", "se", "la", "le", "lo")
ES_PLAIN = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
ES_IC = "adora ador ación adoras adores aciones ante antes ancia ancias acion".split()
ES_OTHER = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente", "encias": "ente"}
ES_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
ES_GU = "en es éis emos".split()
ES_VERBS = """
arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos
erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste
iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases
ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos
ásemos
""".split()


def regions(word: str, vowels: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first consonant that follows a vowel, and the same again within R1."""
    out, at = [], 0
    for _ in range(2):
        m = re.compile(f"[{vowels}][^{vowels}]").search(word, at)
        at = m.end() if m else len(word)
        out.append(at)
    return out[0], out[1]


class Endings:
    """Endings by their lengths, the longest first."""

    def __init__(self, endings: Iterable[str]):
        self.known = frozenset(endings)
        self.sizes = sorted({len(e) for e in self.known}, reverse=True)


endings_of = lru_cache(maxsize=1_000)(Endings)


def ending(word: str, endings: Endings | tuple[str, ...], start: int = 0) -> str:
    """The longest of the endings that the word has from start on, or ''."""
    if isinstance(endings, tuple):
        endings = endings_of(endings)
    most = len(word) - start
    for n in endings.sizes:
        if n <= most and word[-n:] in endings.known:
            return word[-n:]
    return ""


EN_ENDINGS_2, EN_ENDINGS_3, EN_ENDINGS_4 = map(Endings, (EN_STEP_2, EN_STEP_3, EN_STEP_4))
ES_GROUPS = Endings([*ES_PLAIN, *ES_IC, *ES_OTHER, "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"])
ES_Y_ENDINGS, ES_VERB_ENDINGS = Endings(ES_Y), Endings([*ES_GU, *ES_VERBS])


def short_syllable(word: str) -> bool:
    return re.search(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", word) is not None


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in EN_WORDS:
        return EN_WORDS[word]
    word = re.sub(r"(^|[aeiouy])y", r"\1Y", word)
    prefix = re.match("gener|commun|arsen", word)
    r1, r2 = regions(word, EN_VOWELS)
    if prefix:
        r1 = prefix.end()
        r2 = regions(word[r1:], EN_VOWELS)[0] + r1
    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search("[aeiouy]", word[:-2]):
        word = word[:-1]
    if word in EN_AFTER_PLURAL:
        return word
    # past and present participles
    e = ending(word, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if e.startswith("eed"):
        if len(word) - len(e) >= r1:
            word = word[: len(word) - len(e)] + "ee"
    elif e and re.search("[aeiouy]", word[: len(word) - len(e)]):
        word = word[: len(word) - len(e)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            word = word[:-1]
        elif r1 >= len(word) and short_syllable(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in EN_VOWELS:
        word = word[:-1] + "i"
    for table, endings in ((EN_STEP_2, EN_ENDINGS_2), (EN_STEP_3, EN_ENDINGS_3)):
        e = ending(word, endings)
        if e and len(word) - len(e) >= r1:
            stem = word[: len(word) - len(e)]
            if (e == "ogi" and not stem.endswith("l")) or (e == "li" and stem[-1:] not in tuple("cdeghkmnrt")) or (e == "ative" and len(stem) < r2):
                continue
            word = stem + table[e]
    e = ending(word, EN_ENDINGS_4)
    if e and len(word) - len(e) >= r2 and (e != "ion" or word[: -len(e)].endswith(("s", "t"))):
        word = word[: -len(e)]
    if word.endswith("e") and (len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not short_syllable(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def spanish_rv(word: str) -> int:
    """Where RV begins."""
    consonant = f"[^{ES_VOWELS}]"
    if len(word) < 2:
        return len(word)
    if re.match(consonant, word[1]):
        m = re.compile(f"[{ES_VOWELS}]").search(word, 2)
    elif word[0] in ES_VOWELS and word[1] in ES_VOWELS:
        m = re.compile(consonant).search(word, 2)
    else:
        return min(3, len(word))
    return m.end() if m else len(word)


def spanish(word: str) -> str:
    r1, r2 = regions(word, ES_VOWELS)
    rv = spanish_rv(word)
    cut = lambda w, e: w[: len(w) - len(e)] if e else w
    # pronouns after infinitives and gerunds
    e = ending(word, ES_PRONOUNS, rv)
    if e:
        stem = cut(word, e)
        if ending(stem, ("iéndo", "ándo", "ár", "ér", "ír"), rv):
            word = stem.translate(ACUTE)
        elif ending(stem, ("ando", "iendo", "ar", "er", "ir"), rv) or (ending(stem, ("yendo",), rv) and stem.endswith("uyendo")):
            word = stem
    before = word
    drop = lambda w, endings: cut(w, ending(w, endings, r2))
    e = ending(word, ES_GROUPS)
    stem = cut(word, e)
    if e == "amente":
        if len(stem) >= r1:
            word = stem
            if ending(word, ("iv",), r2):
                word = drop(drop(word, ("iv",)), ("at",))
            else:
                word = drop(word, ("os", "ic", "ad"))
    elif e and len(stem) >= r2:
        if e in ES_OTHER:
            word = stem + ES_OTHER[e]
        else:
            more = ("ic",) if e in ES_IC else ("ante", "able", "ible") if e == "mente" else ("abil", "ic", "iv") if e.startswith("idad") else ("at",) if e.startswith("iv") else ()
            word = drop(stem, more)
    if word == before:
        e = ending(word, ES_Y_ENDINGS, rv)
        if e and cut(word, e).endswith("u"):
            word = cut(word, e)
        else:
            e = ending(word, ES_VERB_ENDINGS, rv)
            word = cut(word, e)
            if e in ES_GU and word.endswith("gu"):
                word = word[:-1]
    e = ending(word, ("os", "a", "o", "á", "í", "ó", "e", "é"), rv)
    word = cut(word, e)
    if e in ("e", "é") and word.endswith("gu") and len(word) - 1 >= rv:
        word = word[:-1]
    return word.translate(ACUTE)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The shorter of the English and the Spanish stem, the English one of equals; words with other characters stay."""
    return min(english(word), spanish(word), key=len) if LETTERS.fullmatch(word) else word


def stem_table(words: DataFrame, column: str = "term") -> DataFrame:
    """(term, stem) of the distinct words of a frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w if w is None else stem(w) for w in batch.column(0).to_pylist()], pa.string())], names=["term", "stem"])

    return words.select(F.col(column).alias("term")).distinct().mapInArrow(run, "term string, stem string")
