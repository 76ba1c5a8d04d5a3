"""Column functions over texts and token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Pronouns that count as first person, as they are written, and all personal and possessive ones in lower case.  Fixed values.
FIRST_PERSON = ["I", "me", "my", "mine", "myself"]
PRONOUNS = ["i", "me", "my", "mine", "myself", "we", "us", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves"]
#: Spoken forms of each held sound.  Fixed values.
PHONATIONS = {"a": ["ah", "uh", "huh"], "e": ["eh"], "i": [], "o": ["oh"], "u": [], "m": ["mm", "hmm", "hm", "um"]}
#: Word classes and tenses of Penn treebank tags.  Fixed values.
CLASSES = {"Pronoun": ["PRP", "PRP$"], "Verb": ["VB", "VBD", "VBG", "VBN", "VBP", "VBZ"], "Adjective": ["JJ", "JJR", "JJS"], "Noun": ["NN", "NNP", "NNS"], "Adverb": ["RB", "RBR", "RBS"], "Determiner": ["DT"]}
PRESENT, PAST = ["VBP", "VBZ"], ["VBD", "VBN"]
#: Sonority classes of letters for syllables: vowels, nasals and liquids, fricatives, stops.  Fixed values.
SONORITY = ["aeiouy", "lmnrw", "zvsf", "bcdgtkpqxhj"]


def plain(text: Column) -> Column:
    """Lower case without ASCII punctuation."""
    return F.lower(F.translate(text, PUNCTUATION, ""))


def tokens(text: Column) -> Column:
    return F.filter(F.split(plain(text), "\\s+"), lambda w: w != "")


def brunet(words: Column, a: float = 0.172) -> Column:
    n, v = F.size(words), F.size(F.array_distinct(words))
    return F.when(n >= 10, F.pow(n.cast("double"), F.pow(v.cast("double"), F.lit(-a))))


def honore(words: Column) -> Column:
    """100 ln N / (1 - V1 / V); null for fewer than ten words or if every word occurs once.

    A word occurs once if both of its neighbours in the sorted list differ.
    """
    def of(s):
        alone = lambda w, i: ~F.get(s, i - 1).eqNullSafe(w) & ~F.get(s, i + 1).eqNullSafe(w)
        first = lambda w, i: ~F.get(s, i - 1).eqNullSafe(w)
        return F.struct(F.size(F.filter(s, alone)).alias("once"), F.size(F.filter(s, first)).alias("v"))

    got = F.element_at(F.transform(F.array(F.sort_array(words)), of), 1)
    n, v, once = F.size(words).cast("double"), got["v"].cast("double"), got["once"]
    return F.when((n >= 10) & (once < v), 100 * F.ln(n) / (1 - once / v))


def occurrences(words: Column) -> Column:
    """array<struct<at, before>>: the place of each word and that of the same word before it (-1 for none), in no order."""
    pairs = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("at"))))

    def linked(s):
        before = lambda x, i: F.when(F.get(s, i - 1)["w"].eqNullSafe(x["w"]), F.get(s, i - 1)["at"]).otherwise(F.lit(-1))
        return F.transform(s, lambda x, i: F.struct(x["at"].alias("at"), before(x, i).alias("before")))

    return F.element_at(F.transform(F.array(pairs), linked), 1)


def mattr_of(occurred: Column, window: int) -> Column:
    """Mean share of distinct words in sliding windows, from ``occurrences``; one window if the text is shorter.

    A word is new in the windows that hold it and start after its last place
    before, so each word counts once for so many windows: one pass, whatever the width.
    """
    n = F.size(occurred)
    w = F.least(F.lit(window), n)
    new = lambda x: F.greatest(F.lit(0), F.least(x["at"], n - w) - F.greatest(x["before"] + 1, x["at"] - w + 1, F.lit(0)) + 1)
    total = F.aggregate(occurred, F.lit(0).cast("long"), lambda s, x: s + new(x))
    return F.when(n > 0, total / (w * (n - w + 1)).cast("double"))


def mattr(words: Column, window: int) -> Column:
    return F.element_at(F.transform(F.array(occurrences(words)), lambda o: mattr_of(o, window)), 1)


def repetition(items: Column, window: int) -> Column:
    """Mean per cent of repeats in sliding windows of ``window`` items; one window if there are fewer; null for none.

    Of words, none is no repeat: coalesce to 0.
    """
    return 100 * (1 - mattr(items, window))


def phrases(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[.!?]+"), lambda p: F.trim(plain(p))), lambda p: p != "")


def plain_words(text: Column) -> Column:
    """Words without ASCII punctuation, as they are written."""
    return F.filter(F.split(F.translate(text, PUNCTUATION, ""), "\\s+"), lambda w: w != "")


def first_person_share(words: Column) -> Column:
    """Per cent of first-person ones, as they are written, among pronouns; null if there is none."""
    own = F.size(F.filter(words, lambda w: w.isin(FIRST_PERSON)))
    every = F.size(F.filter(words, lambda w: F.lower(w).isin(PRONOUNS)))
    return F.when(every > 0, 100 * own / every)


def word_class(tag: Column) -> Column:
    out = F.lit("Other")
    for name, tags in CLASSES.items():
        out = F.when(tag.isin(tags), F.lit(name)).otherwise(out)
    return out


def tense(tag: Column) -> Column:
    """Present, Past or Other of verbs, else null."""
    kind = F.when(tag.isin(PRESENT), "Present").when(tag.isin(PAST), "Past").otherwise("Other")
    return F.when(word_class(tag) == "Verb", kind)


def first_person(word: Column, tag: Column) -> Column:
    """Whether a pronoun is first person; null for other words."""
    return F.when(word_class(tag) == "Pronoun", word.isin(FIRST_PERSON))


def syllables(word: Column) -> Column:
    """Syllables of a word in lower case by sonority: a dip starts one, a plateau after a fall ends one; those without a vowel join their neighbours.

    Letters of no class are as sonorous as vowels, as other alphabets have them; a word has at least one syllable.
    """
    value = lambda c: F.when(F.lit(SONORITY[1]).contains(c), 3).when(F.lit(SONORITY[2]).contains(c), 2).when(F.lit(SONORITY[3]).contains(c), 1).otherwise(4)
    vowel = lambda c: F.lit(SONORITY[0]).contains(c)
    chars = F.filter(F.split(word, ""), lambda c: c != "")

    def of(cs):
        vs = F.transform(cs, value)
        at = F.sequence(F.lit(1), F.size(cs) - 2)

        def step(acc, i):
            p, f, n, own = F.get(vs, i - 1), F.get(vs, i), F.get(vs, i + 1), vowel(F.get(cs, i))
            flat, dip = (p >= f) & (f == n), (p > f) & (f < n)
            got = acc["n"] + F.when(flat, F.when(acc["has"] | own, 1).otherwise(0)).when(dip & acc["has"], 1).otherwise(0)
            return F.struct(F.when(flat, F.lit(False)).when(dip, own).otherwise(acc["has"] | own).alias("has"), got.cast("int").alias("n"))

        start = F.struct(vowel(F.get(cs, F.lit(0))).alias("has"), F.lit(0).alias("n"))
        last = vowel(F.get(cs, F.size(cs) - 1))
        folded = F.aggregate(F.when(F.size(cs) > 2, at).otherwise(F.array().cast("array<int>")), start, step, lambda a: a["n"] + F.when(a["has"] | last, 1).otherwise(0))
        return F.when(F.size(F.filter(cs, vowel)) <= 1, F.lit(1)).otherwise(folded)

    return F.element_at(F.transform(F.array(chars), of), 1)


def syllable_sum(words: Column) -> Column:
    return F.aggregate(F.transform(words, syllables), F.lit(0), lambda s, x: s + x)


def folded_quotes(text: Column) -> Column:
    """Typographic quotes and dashes as ASCII ones."""
    return F.translate(text, "‘’“”–—", "''\"\"--")


def diarized(words: Column, speakers: Column) -> Column:
    """`<spk:1> w w <spk:2> w`: a mark wherever the speaker changes."""
    marked = F.transform(words, lambda w, i: F.when((i == 0) | (F.get(speakers, i) != F.get(speakers, i - 1)), F.concat(F.lit("<spk:"), F.get(speakers, i), F.lit("> "), w)).otherwise(w))
    return F.array_join(marked, " ")


def speaker_mark(word: Column) -> Column:
    """The number of a mark `<spk:3>`, 1 to 10; null for other words and for marks that mean nothing."""
    number = F.regexp_extract(word, "^<spk:0*([1-9]|10)>?$", 1)
    return F.when(number != "", number)


def chunk_starts(words: Column, limit: int = 2250) -> Column:
    """Where each chunk begins: words are added while characters and spaces stay within ``limit``."""
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("seen"), F.array().cast("array<int>").alias("out"))

    def step(acc, w):
        size = F.length(w) + 1
        over = (acc["used"] + size > limit) | (acc["seen"] == 0)
        return F.struct(F.when(over, size).otherwise(acc["used"] + size).cast("int").alias("used"), (acc["seen"] + 1).cast("int").alias("seen"), F.when(over, F.concat(acc["out"], F.array(acc["seen"]))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(words, start, step, lambda acc: acc["out"])


def strict_words(text: Column) -> Column:
    """Letters, digits, apostrophes and speaker marks in lower case, with single spaces."""
    kept = F.regexp_replace(F.translate(F.replace(text, F.lit("\n"), F.lit(" ")), "\\", ""), "[^\\p{L}\\p{N} '<>:]+", "")
    return F.lower(F.trim(F.regexp_replace(kept, " +", " ")))


def without_marks(text: Column) -> Column:
    """In lower case and without `,._`, unless that would change the number of words."""
    low = F.lower(text)
    bare = F.trim(F.regexp_replace(low, "[,._]", ""))
    count = lambda t: F.size(F.filter(F.split(t, "\\s+"), lambda w: w != ""))
    return F.when(count(bare) == count(low), bare).otherwise(low)


def speaker_label(label: Column) -> Column:
    """`spk_0` and `SPEAKER_00` style labels in one form."""
    return F.regexp_replace(F.regexp_replace(label, "^spk_", "speaker"), "^SPEAKER_0", "speaker")


def prompt(template: str, chunk: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{text}"), chunk)


def phonation(word: Column) -> Column:
    """The held sound that a word stands for, else null."""
    out = F.lit(None).cast("string")
    for sound, forms in PHONATIONS.items():
        if forms:
            out = F.when(plain(word).isin(forms), F.lit(sound)).otherwise(out)
    return out
