"""Text operators as built-in column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import FILLER, GENERIC_WORDS, NEGATED_WORD, NEGATIONS, OPTIONAL_MARKS, REASON_WORD, REQUIREMENT_ENDS, REQUIREMENT_HEADS, SEPARATORS, STOPWORDS, SYNONYMS, TOKEN_EDGES, variants


def strings(values) -> Column:
    """A literal array of strings."""
    values = sorted(values)
    return F.array(*[F.lit(v) for v in values]) if values else F.expr("cast(array() as array<string>)")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, where use names it in lambdas that would work it out for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Blank-separated words of a text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def spaced(text: Column) -> Column:
    """The lower-cased text with hyphens parted, whose words between blanks are the tokens without synonyms and stop words."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), "-", " ")


def tokens(text: Column, stopwords=STOPWORDS, synonyms: dict[str, list[str]] | None = SYNONYMS) -> Column:
    """Lower-cased words, hyphens parted, each followed by its synonyms' words, without stop words; marks stay attached."""
    low = spaced(text)
    for key in (k for k in synonyms or {} if " " in k):
        # the only two-word keys are joined to one word first, left to right, as pairs that do not overlap
        first, second = key.split(" ")
        joined = F.regexp_replace(low, rf"(?U)(?<=^|\s){re.escape(first)}\s+{re.escape(second)}(?=\s|$)", f"{first}\0{second}")
        low = F.when(F.contains(low, F.lit(first)) & F.contains(low, F.lit(second)), joined).otherwise(low)
    found = words(low)
    if synonyms:
        table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k.replace(" ", "\0")), F.array(*[F.lit(w) for s in v for w in s.split()]))])
        known = [k.replace(" ", "\0") for k in synonyms]
        expand = lambda w: F.when(w.isin(known), F.concat(F.array(F.translate(w, "\0", " ")), table[w])).otherwise(F.array(w))
        found = F.flatten(F.transform(found, expand))
    return F.filter(found, lambda w: ~w.isin(*sorted(stopwords))) if stopwords else found


def normalise(text: Column) -> Column:
    """Lower case, with - / + made blanks."""
    return F.translate(F.lower(text), "-/+", "   ")


def contains_term(text: Column, term: str) -> Column:
    """Whether the term or a variant stands in the text between characters other than a-z and 0-9."""
    each = [F.lower(text).rlike(rf"(^|[^a-z0-9])\Q{v}\E([^a-z0-9]|$)") for v in variants(term)]
    out = each[0]
    for more in each[1:]:
        out = out | more
    return out


def term_pattern(term: str) -> tuple[str, bool]:
    """The Java pattern that counts a term, and whether it reads the raw (lower-cased) text.

    A term with separators stands in the raw text; an end of it that is a mark
    needs no border, so "c++" counts in "c++17". Other terms stand in the
    normalised text between borders of words, any white space between their words.
    """
    low = term.lower()
    raw = not set(SEPARATORS).isdisjoint(low)
    body = f"\\Q{low}\\E" if raw else r"\s+".join(f"\\Q{part}\\E" for part in low.split(" "))
    borders = [not raw or end.isalnum() for end in (low[:1], low[-1:])]
    return "(?U)" + r"(?<!\w)" * borders[0] + body + r"(?!\w)" * borders[1], raw


def count_term(text: Column, term: str) -> Column:
    """How often the term stands in the text as a whole word."""
    pattern, raw = term_pattern(term)
    return F.regexp_count(F.lower(text) if raw else normalise(text), F.lit(pattern))


def edge_trimmed(word: Column) -> Column:
    return F.btrim(word, F.lit(TOKEN_EDGES))


def dictionary_terms(text: Column, dictionary) -> Column:
    """Terms of the dictionary in a text: two-word terms consume their words before single words count; then terms with separators."""
    dictionary = set(dictionary)
    plain = strings(t for t in dictionary if " " not in t)
    double = strings(t for t in dictionary if t.count(" ") == 1)
    found = F.transform(words(normalise(text)), edge_trimmed)
    start = F.struct(F.lit("").alias("held"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, w: Column) -> Column:
        pair = F.concat_ws(" ", acc["held"], w)
        is_pair = (acc["held"] != "") & F.array_contains(double, pair)
        single = F.when(F.array_contains(plain, acc["held"]), F.concat(acc["out"], F.array(acc["held"]))).otherwise(acc["out"])
        # the word before waits until it's known not to open a pair
        return F.when(is_pair, F.struct(F.lit("").alias("held"), F.concat(acc["out"], F.array(pair)).alias("out"))).otherwise(F.struct(w.alias("held"), single.alias("out")))

    folded = F.aggregate(F.concat(found, F.array(F.lit(" "))), start, step, lambda acc: acc["out"])
    apart = [t for t in sorted(dictionary) if any(c in t for c in "+#.-/")]
    hits = F.array_compact(F.array(*[F.when(F.lower(text).rlike(term_pattern(t)[0]), F.lit(t)) for t in apart])) if apart else F.expr("cast(array() as array<string>)")
    return F.array_sort(F.array_distinct(F.concat(folded, hits)))


def pairs_of(items: Column) -> Column:
    """Neighbours as two words joined by a blank."""
    return F.array_compact(F.zip_with(items, F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b))))


def usable(skip) -> Callable[[Column], Column]:
    """Whether a word has three letters and is none of those to skip."""
    return lambda w: (F.length(w) >= 3) & ~w.isin(*sorted(skip))


def open_candidates(text: Column) -> Column:
    """Words and pairs of neighbours that open_terms can find, whatever a corpus holds."""
    fit = usable({*GENERIC_WORDS, *STOPWORDS})
    found = F.transform(words(normalise(text)), edge_trimmed)
    both = F.filter(pairs_of(found), lambda p: fit(F.substring_index(p, " ", 1)) & fit(F.substring_index(p, " ", -1)))
    return F.array_distinct(F.concat(F.filter(found, fit), both))


def open_terms(text: Column, held: Column, known) -> Column:
    """One- and two-word terms outside the dictionary that a corpus holds word for word (held: those of open_candidates that it does); pairs consume their words."""
    fit = usable({*known, *GENERIC_WORDS, *STOPWORDS})
    start = F.struct(F.lit("").alias("last"), F.expr("cast(array() as array<string>)").alias("out"))

    def found(h: Column) -> Column:
        def step(acc: Column, w: Column) -> Column:
            pair = F.concat_ws(" ", acc["last"], w)
            is_pair = fit(acc["last"]) & fit(w) & F.array_contains(h, pair)
            single = F.when(fit(acc["last"]) & F.array_contains(h, acc["last"]), F.concat(acc["out"], F.array(acc["last"]))).otherwise(acc["out"])
            return F.when(is_pair, F.struct(F.lit("").alias("last"), F.concat(acc["out"], F.array(pair)).alias("out"))).otherwise(F.struct(w.alias("last"), single.alias("out")))

        return F.array_sort(F.array_distinct(F.aggregate(F.concat(F.transform(words(normalise(text)), edge_trimmed), F.array(F.lit(""))), start, step, lambda acc: acc["out"])))

    return once(F.coalesce(held, F.expr("cast(array() as array<string>)")), found)


def custom_terms(terms: list[str] | str | None) -> list[str]:
    """Given terms trimmed, lower-cased, without blanks and repeats; a string is split at commas."""
    parts = terms.split(",") if isinstance(terms, str) else terms or []
    return list(dict.fromkeys(p for p in (str(t).strip().lower() for t in parts) if p))


def requirements(text: Column) -> Column:
    """The requirements section of an offer, else what stands before its optional part, else all of it."""
    head, ends, marks = "|".join(REQUIREMENT_HEADS), "|".join(REQUIREMENT_ENDS), "|".join(OPTIONAL_MARKS)
    section = rf"(?isu)(?:{head})[\s:]*(.+?)(?=\n(?:{ends}|\z|\n\z))"
    cut = rf"(?isu)^(.*?)(?:{marks})[\s:]*(.+?)(?=\n|\z)"
    before, after = F.regexp_extract(text, cut, 1), F.regexp_extract(text, cut, 2)
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(text.rlike(section), strip(F.regexp_extract(text, section, 1))).when(text.rlike(cut), strip(F.when(before != "", before).otherwise(after))).otherwise(strip(text))


def chunks(text: Column, size: int = 200, overlap: int = 50) -> Column:
    """Windows of `size` words, `overlap` shared; a text within one window stays as it is."""
    stride = size - overlap

    def windows(found: Column) -> Column:
        # a window starts at each stride up to the one that reaches the last word
        starts = F.sequence(F.lit(0), F.greatest(F.size(found) - overlap - 1, F.lit(0)), F.lit(stride))
        return F.when(F.size(found) <= size, F.array(text)).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(found, i + 1, F.lit(size)), " ")))

    return once(words(text), windows)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?\n]+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def negated(sentence: Column, patterns=NEGATIONS) -> Column:
    return sentence.rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns))


def negated_candidates(text: Column, patterns=NEGATIONS) -> Column:
    """Words and pairs of the negated sentences that negated_terms can find, whatever a corpus holds."""
    none = F.expr("cast(array() as array<string>)")
    found = once(F.array_join(F.filter(sentences(text), lambda s: negated(s, patterns)), " "), fragment_terms)
    # a word that no sentence can hold is not in the text, which is known without parting it
    return F.when(negated(text, patterns), found).otherwise(none) if all(re.fullmatch(r"\w+", p) for p in patterns) else found


def fragment_terms(fragment: Column) -> Column:
    """Words and pairs of negated sentences."""
    pieces = F.transform(F.regexp_extract_all(fragment, F.lit(NEGATED_WORD), F.lit(1)), lambda w: F.lower(w))
    return once(F.filter(pieces, usable({*STOPWORDS, *GENERIC_WORDS})), lambda single: F.array_distinct(F.concat(single, pairs_of(single))))


def stands_in(text: Column, term: Column) -> Column:
    """Whether a term stands in a lower-cased text between characters other than a-z and 0-9."""
    # most texts lack the term altogether, which is known without a pattern
    return F.contains(text, term) & F.regexp_like(text, F.concat(F.lit(r"(^|[^a-z0-9])\Q"), term, F.lit(r"\E([^a-z0-9]|$)")))


def variants_of(keyword: Column) -> Column:
    """A keyword's variants, itself among them."""
    terms = dict.fromkeys(t for k, v in SYNONYMS.items() for t in (k, *v))
    table = F.create_map(*[x for t in terms for x in (F.lit(t), F.array(*[F.lit(v) for v in variants(t)]))])
    low = F.lower(F.trim(keyword))
    return F.when(low.isin(*terms), table[low]).otherwise(F.array(low))


def mentions(text: Column, term: Column) -> Column:
    """Whether a term or a variant of it stands in a lower-cased text between characters other than a-z and 0-9."""
    return F.exists(variants_of(term), lambda v: stands_in(text, v))


def excludes(negated: Column, text: Column) -> Column:
    """Whether a text mentions one of the terms that a query excludes."""
    return once(F.lower(text), lambda low: F.exists(negated, lambda t: mentions(low, t)))


def negated_terms(text: Column, held: Column, dictionary=(), patterns=NEGATIONS) -> Column:
    """Terms that a text excludes: dictionary terms, and those of negated_candidates that a corpus holds, unless another sentence names them or a variant of theirs."""
    none = F.expr("cast(array() as array<string>)")
    parts = F.transform(sentences(text), lambda s: F.struct(s.alias("s"), negated(s, patterns).alias("negated")))
    joined = lambda said, which: F.array_join(F.transform(F.filter(said, which), lambda x: x["s"]), " ")

    def found(both: Column) -> Column:
        opened = F.array_intersect(fragment_terms(both["fragment"]), F.coalesce(held, none))
        listed = dictionary_terms(both["fragment"], dictionary) if dictionary else none
        return F.array_sort(F.filter(F.array_distinct(F.concat(listed, opened)), lambda t: ~mentions(both["positive"], t)))

    both = once(parts, lambda said: F.struct(joined(said, lambda x: x["negated"]).alias("fragment"), F.lower(joined(said, lambda x: ~x["negated"])).alias("positive")))
    return once(both, found)


def text_lines(text: Column, width: int = 90) -> Column:
    """Printed lines of a running text; none for a blank one."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", 0).otherwise(F.greatest(F.lit(1), F.ceil(F.length(text) / width).cast("int")))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token sets; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def month_key(date: Column) -> Column:
    """Partial dates as months: present, blank and null last of all, what is neither YYYY-MM nor YYYY first."""
    low = F.lower(F.trim(F.coalesce(date.cast("string"), F.lit(""))))
    month = F.regexp_extract(low, r"^(\d{4})-(\d{1,2})$", 2).try_cast("int")
    year = F.regexp_extract(low, r"^(\d{4})(?:-\d{1,2})?$", 1).try_cast("int")
    return F.when(low.isin("", "present"), F.lit(10**6)).when(month.between(1, 12), year * 12 + month).when(low.rlike(r"^\d{4}$"), year * 12 + 1).otherwise(F.lit(-(10**6)))


def reason_words(text: Column) -> Column:
    """Distinct words of three letters or more that can explain a match."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(REASON_WORD), F.lit(0)))
    return F.filter(found, lambda w: ~w.isin(*sorted(STOPWORDS | FILLER)))
