"""Text columns: language, normalisation, tokens, n-grams and phrases, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridprint.functions import lists

LETTERS = r"[\p{L}]+"


def detect_language(text: Column) -> Column:
    """`fa` or `ar` for text with Arabic script, by letters that only Persian has; otherwise `en`."""
    arabic = text.rlike(f"[{lists.ARABIC_LETTERS}]")
    return F.when(arabic & text.rlike(f"[{lists.PERSIAN_LETTERS}]"), "fa").when(arabic, "ar").otherwise("en")


def detect_word_language(word: Column) -> Column:
    """`fa`, `en` or `other` for a word."""
    return F.when(word.rlike(f"[{lists.ARABIC_LETTERS}]"), "fa").when(word.rlike("[a-zA-Z]"), "en").otherwise("other")


def split_bilingual(text: Column) -> tuple[Column, Column]:
    """(Arabic part, English part), cut after the last Arabic-script character; commas, quotes and blanks trimmed."""
    pattern = f"(?s)^(.*[{lists.ARABIC_LETTERS}])?(.*)$"

    def clean(c: Column) -> Column:
        return F.regexp_replace(c, "^[\\s,\"']+|[\\s,\"']+$", "")

    return clean(F.regexp_extract(text, pattern, 1)), clean(F.regexp_extract(text, pattern, 2))


def normalize_hyphens(text: Column) -> Column:
    """A hyphen between letters becomes a space, in one pass from the left."""
    return F.regexp_replace(text, r"\b([a-zA-Z]+)-([a-zA-Z]+)\b", "$1 $2")


def fold_arabic(text: Column) -> Column:
    """Marks deleted, letter variants folded."""
    return F.translate(text, lists.ARABIC_FOLD_FROM, lists.ARABIC_FOLD_TO)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(LETTERS), F.lit(0))


def is_generic(word: Column, min_length: int = 3) -> Column:
    """Too short, a stop word, or a number."""
    return (F.length(word) < min_length) | word.isin(lists.STOP_WORDS) | word.rlike("^[0-9]+$")


def ngrams(words: Column, low: int = 1, high: int = 3) -> Column:
    """All runs of low..high words, joined by a space."""
    def of(n: int) -> Column:
        count = F.size(words) - (n - 1)
        return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[of(n) for n in range(low, high + 1)]))


def arabic_phrases(words: Column, function_words: list[str] | None = None) -> Column:
    """Content words of three letters or more, and pairs and triples that don't begin with a clitic or consist of function words."""
    stop = lists.ARABIC_FUNCTION_WORDS if function_words is None else function_words
    folded = F.transform(words, fold_arabic)

    def of(n: int) -> Column:
        count = F.size(folded) - (n - 1)
        runs = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.slice(folded, i, n))).otherwise(F.array().cast("array<array<string>>"))
        if n == 1:
            fits = F.filter(runs, lambda r: (F.length(r[0]) >= 3) & ~r[0].isin(stop))
        else:
            fits = F.filter(runs, lambda r: ~r[0].isin(lists.ARABIC_CLITICS) & F.exists(r, lambda w: ~w.isin(stop)))
        return F.transform(fits, lambda r: F.array_join(r, " "))

    return F.array_distinct(F.flatten(F.array(of(1), of(2), of(3))))


def unfiltered_phrases(words: Column) -> Column:
    """Words of two letters or more, and all pairs and triples."""
    return F.array_distinct(F.concat(F.filter(words, lambda w: F.length(w) >= 2), ngrams(words, 2, 3)))


def normalize_arabic_phrase(text: Column, function_words: list[str] | None = None) -> Column:
    """P5: folded content words of a phrase; null if none, more than five, or only a clitic with a letter are left."""
    stop = lists.ARABIC_FUNCTION_WORDS if function_words is None else function_words
    folded = fold_arabic(F.regexp_replace(F.trim(text), "[ً-ٰٟ]", ""))
    words = F.filter(F.split(folded, r"\s+"), lambda w: ~w.isin(stop) & (F.length(w) >= 2))
    clitic = F.lit(False)
    for c in lists.ARABIC_CLITICS:
        clitic = clitic | (F.get(words, F.lit(0)).startswith(c) & (F.length(F.get(words, F.lit(0))) - len(c) <= 1))
    bad = (F.size(words) == 0) | (F.size(words) > 5) | (F.size(words) > 1) & ~F.exists(words, lambda w: F.length(w) >= 3) | (F.size(words) == 1) & clitic
    return F.when(~bad, F.array_join(words, " "))


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whether the phrase stands in the text between word boundaries; case counts."""
    return F.regexp_like(text, F.concat(F.lit(r"(?U)\b\Q"), phrase, F.lit(r"\E\b")))


def count_occurrences(text: Column, phrase: Column, boundaries: bool = True) -> Column:
    """Places of the phrase, whatever the case; with boundaries on words, else on characters."""
    if boundaries:
        return F.regexp_count(F.lower(text), F.concat(F.lit(r"(?U)\b\Q"), F.lower(phrase), F.lit(r"\E\b")))
    return F.when(F.length(phrase) > 0, ((F.length(text) - F.length(F.replace(F.lower(text), F.lower(phrase), F.lit("")))) / F.length(phrase)).cast("int")).otherwise(0)


def spans(phrase: Column, longest: int = 5, min_length: int = 3, filter_generic: bool = True) -> Column:
    """The phrase and its contiguous parts of at most `longest` words, sorted and distinct; generic single words left out."""
    words = F.filter(F.split(F.lower(F.trim(phrase)), r"\s+"), lambda w: w != "")
    every = F.concat(F.array(F.array_join(words, " ")), ngrams(words, 1, longest))
    kept = F.filter(every, lambda s: (s != "") & (F.contains(s, F.lit(" ")) | ~is_generic(s, min_length) if filter_generic else F.lit(True)))
    return F.array_sort(F.array_distinct(kept))


def wordnet_pos(tag: Column) -> Column:
    """P10: part of speech of a Treebank tag; nouns by default."""
    out = F.lit("n")
    for prefix, pos in reversed(lists.POS_TAGS.items()):
        out = F.when(tag.startswith(prefix), pos).otherwise(out)
    return out


def verb_stem(stem: Column) -> Column:
    """What is left of a form in -ing, -ed or -est: a doubled consonant becomes one, an -e that was dropped comes back."""
    doubled = stem.rlike(r"([bdgkmnprt])\1$")
    short = stem.rlike("^[^aeiou]*[aeiouy][^aeiouwxy]$")  # one syllable that ends with vowel and consonant: mak-e, hop-e
    open_end = stem.rlike("([^e]at|bl|iz|yz|[cuv]|[lr]g|[bcdfgkpt]l|[ae][aiu]s|[^aeiou][aeio]s)$") | stem.isin("creat", "us")
    return F.when(doubled, F.substring(stem, F.lit(1), F.length(stem) - 1)).when(short | open_end, F.concat(stem, F.lit("e"))).otherwise(stem)


def lemma(word: Column, pos: Column | None = None) -> Column:
    """An approximation by suffix rules and a table of irregular forms."""
    w = F.lower(word)

    def rules(pairs: list[tuple[str, str]]) -> Column:
        out = w
        for end, into in reversed(pairs):
            out = F.when(w.endswith(end) & (F.length(w) - len(end) + len(into) >= 3), F.concat(F.substring(w, F.lit(1), F.length(w) - len(end)), F.lit(into))).otherwise(out)
        return out

    table = F.lit(None).cast("string")
    for form, base in lists.IRREGULAR.items():
        table = F.when(w == form, base).otherwise(table)
    stem = F.regexp_extract(w, "^(.*[aeiouy].*)(?:ing|ed)$", 1)
    verb = F.when(w.endswith("ied"), rules(lists.VERB_SUFFIXES)).when(stem != "", verb_stem(stem)).otherwise(rules(lists.VERB_SUFFIXES))
    adjective = F.when(w.rlike("[^aeiou]i(er|est)$"), F.regexp_replace(w, "i(er|est)$", "y")).when(w.rlike("^.{3,}est$"), verb_stem(F.regexp_extract(w, "^(.*)est$", 1))).otherwise(w)
    by_rule = rules(lists.NOUN_SUFFIXES) if pos is None else F.when(pos == "v", verb).when(pos == "n", rules(lists.NOUN_SUFFIXES)).when(pos == "a", adjective).otherwise(w)
    return F.coalesce(table, by_rule)


def valid_structure(tagged: Column) -> Column:
    """From an array of {tok, tag}: not all verbs, not all adverbs, and several words must end with a noun."""
    noun = lambda x: x["tag"].startswith("NN")
    size = F.size(tagged)
    last = F.get(tagged, size - 1)["tag"]
    return (size > 0) & ~F.forall(tagged, lambda x: x["tag"].startswith("VB")) & ~F.forall(tagged, lambda x: x["tag"].startswith("RB")) & ((size == 1) | F.exists(tagged, noun) & last.startswith("NN"))


def functional_verb(lemma_: Column) -> Column:
    """Auxiliaries and verbs that only link."""
    return lemma_.isin("be", "have", "do", "get", "make", "let", "become", "seem")


def normalize_phrase(text: Column, min_length: int = 3) -> Column:
    """N1 without a tagger: words, stop words dropped, lemmas; null if nothing is left."""
    kept = F.transform(F.filter(tokens(text), lambda w: ~is_generic(w, min_length)), lambda w: lemma(w))
    return F.when(F.size(kept) > 0, F.array_join(kept, " "))


def bigram_candidates(tagged: Column) -> Column:
    """Adjacent pairs of adjective, participle or noun, and noun, from an array of {tok, tag}."""
    count = F.size(tagged) - 1
    pairs = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.struct(F.get(tagged, i).alias("a"), F.get(tagged, i + 1).alias("b")))).otherwise(F.array().cast("array<struct<a:struct<tok:string,tag:string>,b:struct<tok:string,tag:string>>>"))
    fits = F.filter(pairs, lambda p: p["a"]["tag"].rlike("^(JJ|VBN|NN)") & p["b"]["tag"].startswith("NN"))
    return F.transform(fits, lambda p: F.concat_ws(" ", p["a"]["tok"], p["b"]["tok"]))


def json_object(text: Column) -> Column:
    """The part of a reply from its first opening to its last closing brace."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def estimate_tokens(text: Column) -> Column:
    """G1: a quarter of the characters."""
    return F.floor(F.length(text) / 4).cast("long")


def sentences(text: Column) -> Column:
    """Cut after . ! ? before a capital letter, or at blank lines."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+(?=\p{Lu})|\n\s*\n")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def credit_error(message: Column) -> Column:
    """Whether a failure is about credit."""
    return F.lower(F.coalesce(message, F.lit(""))).rlike("|".join(lists.CREDIT_WORDS))
