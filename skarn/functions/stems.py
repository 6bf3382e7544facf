"""Stop words and stems as Column expressions: no user code, and only distinct terms need to pass through them."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of three languages.
STOP_WORDS = {
    "english": """a an and are as at be by for from has he in is it its of on that the to was were will with this but they have had
        what when where who which why how all each every both few more most other some such no nor not only own same so than too
        very just can should now i you we your my""".split(),
    "spanish": """a al algo algunas algunos ante antes como con contra cual cuando de del desde donde durante e el ella ellas ellos en
        entre era erais eran eras eres es esa esas ese eso esos esta estado estas este esto estos fue fueron ha hacia han hasta hay
        la las le les lo los me mi mis mucho muy nada ni no nos nosotros nuestra nuestras nuestro nuestros o os otra otras otro otros
        para pero poco por porque que quien se ser si sin sobre somos son soy su sus te ti tiene tienen toda todas todo todos tu tus
        un una uno unos vosotras vosotros vuestra vuestras vuestro vuestros y ya yo""".split(),
    "french": """au aux avec ce ces dans de des du elle en et eux il je la le les leur lui ma mais me meme mes moi mon ne nos notre nous
        on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous c d j l a m n s t y ete etee etees
        etes etant suis es est sommes sont serai seras sera serons serez seront""".split(),
}
#: Languages whose longer lists come from Spark, without accents as well.
SPARK_LISTS = ("german", "italian", "portuguese")


def stop_words(language: str) -> list[str]:
    """The words that an index of the language leaves out; none for "none"."""
    if language in SPARK_LISTS:
        from pyspark.ml.feature import StopWordsRemover

        found = StopWordsRemover.loadDefaultStopWords(language)
        plain = ["".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c)) for w in found]
        return sorted({*found, *plain})
    if language != "none" and language not in STOP_WORDS:
        raise ValueError(f"unknown language: {language}")
    return STOP_WORDS.get(language, [])


# Porter's stemmer (1980). A word is [C](VC){m}[V] of runs of consonants and vowels; y is a vowel behind a consonant.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
HAS_VOWEL = f"^(?:{_C})?[aeiouy]"
ABOVE_0 = f"^(?:{_C})?{_V}{_C}"
JUST_1 = f"^(?:{_C})?{_V}{_C}(?:{_V})?$"
ABOVE_1 = f"^(?:{_C})?{_V}{_C}{_V}{_C}"
SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"
#: Endings of the steps and what stands in their place.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
SPANISH = """amientos imientos amiento imiento aciones uciones adores adoras idades ancias encias mente adora ador antes ancia encia icas icos
    ismos ables ibles istas osas osos iva ivo ica ico oso osa able ible ista ismo ando endo aron ieron aban aran ido ado ar er ir as es is
    os a e i o""".split()


def _named(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is made once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _ending(word: Column, endings: list[str], least: int = 1) -> Column:
    """What stands before the longest of the endings (s), and that ending (e); both empty without one."""
    pattern = f"^(.{{{least},}}?)({'|'.join(endings)})$"
    return F.struct(F.regexp_extract(word, pattern, 1).alias("s"), F.regexp_extract(word, pattern, 2).alias("e"))


def _replaced(endings: dict[str, str]) -> Callable[[Column], Column]:
    new = F.create_map(*[F.lit(x) for pair in endings.items() for x in pair])

    def step(word: Column) -> Column:
        cut = lambda x: F.when((x["e"] != "") & x["s"].rlike(ABOVE_0), F.concat(x["s"], F.element_at(new, x["e"]))).otherwise(word)
        return _named(_ending(word, list(endings)), cut)

    return step


def _cut(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _plural(w: Column) -> Column:
    return F.when(w.endswith("sses") | w.endswith("ies"), _cut(w, 2)).when(w.endswith("s") & ~w.endswith("ss"), _cut(w, 1)).otherwise(w)


def _past(w: Column) -> Column:
    def whole(s: Column) -> Column:
        return F.when(s.rlike("(?:at|bl|iz)$"), F.concat(s, F.lit("e"))).when(s.rlike(r"([^aeiouylsz])\1$"), _cut(s, 1)).when(s.rlike(SHORT), F.concat(s, F.lit("e"))).otherwise(s)

    def cut(x: Column) -> Column:
        long_e = F.when(x["s"].rlike(ABOVE_0), F.concat(x["s"], F.lit("ee"))).otherwise(w)
        return F.when(x["e"] == "eed", long_e).when((x["e"] != "") & x["s"].rlike(HAS_VOWEL), whole(x["s"])).otherwise(w)

    return _named(_ending(w, ["eed", "ed", "ing"]), cut)


def _last_y(w: Column) -> Column:
    return F.when(w.endswith("y") & _cut(w, 1).rlike(HAS_VOWEL), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _suffix(w: Column) -> Column:
    cut = lambda x: F.when((x["e"] != "") & x["s"].rlike(ABOVE_1) & ((x["e"] != "ion") | x["s"].rlike("[st]$")), x["s"]).otherwise(w)
    return _named(_ending(w, STEP_4), cut)


def _last_e(w: Column) -> Column:
    s = _cut(w, 1)
    return F.when(w.endswith("e") & (s.rlike(ABOVE_1) | s.rlike(JUST_1) & ~s.rlike(SHORT)), s).otherwise(w)


def _last_l(w: Column) -> Column:
    return F.when(w.endswith("ll") & w.rlike(ABOVE_1), _cut(w, 1)).otherwise(w)


def english_stem(word: Column) -> Column:
    """Porter's stem of a word in lower case; words of one or two letters stay."""
    out = word
    for step in (_plural, _past, _last_y, _replaced(STEP_2), _replaced(STEP_3), _suffix, _last_e, _last_l):
        out = _named(out, step)
    return F.when(F.length(word) < 3, word).otherwise(out)


def spanish_stem(word: Column) -> Column:
    """Without the longest ending that leaves two letters or more."""
    return _named(_ending(word, SPANISH, 2), lambda x: F.when((F.length(word) >= 3) & (x["e"] != ""), x["s"]).otherwise(word))


def stem(word: Column, language: str) -> Column:
    """The stem of a word; languages without rules of their own have the English ones, "none" has none."""
    return word if language == "none" else spanish_stem(word) if language == "spanish" else english_stem(word)
