"""Parsers and normalizers of free-text answers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words, articles, contractions and marks of the usual answer normalization.
NUMBERS = {"none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
ARTICLES = ("a", "an", "the")
MARKS = (";", "/", "[", "]", '"', "{", "}", "(", ")", "=", "+", "\\", "_", "-", ">", "<", "@", "`", ",", "?", "!")
CONTRACTIONS = {
    "aint": "ain't", "arent": "aren't", "cant": "can't", "couldve": "could've", "couldnt": "couldn't", "couldn'tve": "couldn't've", "couldnt've": "couldn't've", "didnt": "didn't", "doesnt": "doesn't", "dont": "don't",
    "hadnt": "hadn't", "hadnt've": "hadn't've", "hadn'tve": "hadn't've", "hasnt": "hasn't", "havent": "haven't", "hed": "he'd", "hed've": "he'd've", "he'dve": "he'd've", "hes": "he's", "howd": "how'd", "howll": "how'll", "hows": "how's",
    "isnt": "isn't", "itd": "it'd", "itd've": "it'd've", "it'dve": "it'd've", "itll": "it'll", "let's": "let's", "maam": "ma'am", "mightnt": "mightn't", "mightnt've": "mightn't've", "mightn'tve": "mightn't've", "mightve": "might've",
    "mustnt": "mustn't", "mustve": "must've", "neednt": "needn't", "notve": "not've", "oclock": "o'clock", "oughtnt": "oughtn't", "ow's'at": "'ow's'at", "'ows'at": "'ow's'at", "'ow'sat": "'ow's'at", "shant": "shan't",
    "shed've": "she'd've", "she'dve": "she'd've", "she's": "she's", "shouldve": "should've", "shouldnt": "shouldn't", "shouldnt've": "shouldn't've", "shouldn'tve": "shouldn't've", "somebody'd": "somebodyd", "somebodyd've": "somebody'd've",
    "somebody'dve": "somebody'd've", "somebodyll": "somebody'll", "somebodys": "somebody's", "someoned": "someone'd", "someoned've": "someone'd've", "someone'dve": "someone'd've", "someonell": "someone'll", "someones": "someone's",
    "somethingd": "something'd", "somethingd've": "something'd've", "something'dve": "something'd've", "somethingll": "something'll", "thats": "that's", "thered": "there'd", "thered've": "there'd've", "there'dve": "there'd've", "therere": "there're",
    "theres": "there's", "theyd": "they'd", "theyd've": "they'd've", "they'dve": "they'd've", "theyll": "they'll", "theyre": "they're", "theyve": "they've", "twas": "'twas", "wasnt": "wasn't", "wed've": "we'd've", "we'dve": "we'd've", "weve": "we've",
    "werent": "weren't", "whatll": "what'll", "whatre": "what're", "whats": "what's", "whatve": "what've", "whens": "when's", "whered": "where'd", "wheres": "where's", "whereve": "where've", "whod": "who'd", "whod've": "who'd've", "who'dve": "who'd've",
    "wholl": "who'll", "whos": "who's", "whove": "who've", "whyll": "why'll", "whyre": "why're", "whys": "why's", "wont": "won't", "wouldve": "would've", "wouldnt": "wouldn't", "wouldnt've": "wouldn't've", "wouldn'tve": "wouldn't've",
    "yall": "y'all", "yall'll": "y'all'll", "y'allll": "y'all'll", "yall'd've": "y'all'd've", "y'alld've": "y'all'd've", "y'all'dve": "y'all'd've", "youd": "you'd", "youd've": "you'd've", "you'dve": "you'd've", "youll": "you'll", "youre": "you're", "youve": "you've",
}
LETTERS = ("A", "B", "C", "D", "E")
# Fixed values end.


def once(x: Column, f) -> Column:
    """``f(x)`` with ``x`` evaluated a single time, however often ``f`` uses it: bound as a lambda's variable."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def looked_up(w: Column, table: dict) -> Column:
    """The word's entry, or the word: a hashed membership test spares most words the search of the map."""
    entries = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return F.when(w.isin(*table), F.try_element_at(entries, w)).otherwise(w)


def strip(x: Column) -> Column:
    """Without white space at both ends, of any kind (``trim`` takes spaces only)."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def tokenize_word(x: Column) -> Column:
    return strip(F.replace(F.replace(F.replace(F.lower(x), F.lit(","), F.lit("")), F.lit("?"), F.lit("")), F.lit("'s"), F.lit(" 's")))


def punctuation(x: Column) -> Column:
    """Each mark goes if anywhere in the input it touches a space, or a comma stands between digits; else it is a space.

    Stops that no digit follows go. The tests look at the input, not at what earlier marks left.
    """
    return once(x, _punctuation)


def _punctuation(x: Column) -> Column:
    digits = x.rlike("[0-9],[0-9]")
    out = x
    for m in MARKS:
        touches = F.contains(x, F.lit(m + " ")) | F.contains(x, F.lit(" " + m)) | digits
        out = F.replace(out, F.lit(m), F.when(touches, "").otherwise(" "))
    return F.regexp_replace(out, r"\.(?![0-9])", "")


def digits_articles(x: Column) -> Column:
    """Number words as digits, no articles, contractions with their apostrophes, single spaces."""
    words = F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != "")
    words = F.transform(words, lambda w: looked_up(w, NUMBERS))
    words = F.filter(words, lambda w: ~w.isin(*ARTICLES))
    return F.array_join(F.transform(words, lambda w: looked_up(w, CONTRACTIONS)), " ")


def normalize(x: Column) -> Column:
    flat = strip(F.translate(tokenize_word(x), "\n\t", "  "))
    return digits_articles(punctuation(flat))


def yes_no(x: Column) -> Column:
    """'no' if the first sentence has the word No, no or not; else 'yes'."""
    first = F.replace(F.substring_index(x, ".", 1), F.lit(","), F.lit(""))
    return F.when(F.arrays_overlap(F.split(first, " "), F.array(*[F.lit(w) for w in ("No", "not", "no")])), "no").otherwise("yes")


def choice_letter(x: Column, letters=LETTERS) -> Column:
    """A lone letter, 'X. ' in front, or 'The answer is X' once with any character after it; else FAILED."""
    found = F.regexp_extract_all(x, F.lit("The answer is ([A-Z])."), F.lit(1))
    return F.when(x.isin(*letters), x).when(x.rlike(f"^[{''.join(letters)}]\\. "), F.substring(x, 1, 1)).when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise("FAILED")


def choice_index(letter: Column, n_choices: Column, letters=LETTERS) -> Column:
    """The letter's place among the first ``n_choices`` letters, -1 if it isn't there."""
    return (F.array_position(F.slice(F.array(*[F.lit(c) for c in letters]), F.lit(1), n_choices), letter) - 1).cast("int")


def rstrip_stops(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"\.+$", ""))


def multi_choice(text: Column, options: Column, seed: int = 0) -> Column:
    """The option letter that a free response names last.

    ``options``: array of (letter, answer). Letters in brackets count before lone letters, these before
    answers' texts in responses of more than five words. If nothing is named a letter is drawn by a hash.
    """
    t = text
    for c in (",", ".", "!", "?", ";", ":", "'"):
        t = F.regexp_replace(t, f"^[{c}]+|[{c}]+$", "")
    t = F.concat(F.lit(" "), t, F.lit(" "))
    hays = {False: t, True: F.lower(t)}

    def last(form, fold):
        """The option whose form stands last in the text; of equal places the earlier option."""
        hay = hays[fold]
        place = lambda o: F.length(F.call_function("substring_index", hay, form(o), F.lit(-1)))  # noqa: E731  what follows the last occurrence
        got = F.transform(options, lambda o, i: F.when(F.contains(hay, form(o)), F.struct((place(o) + F.length(form(o))).alias("back"), i.alias("i"), o["letter"].alias("letter"))))
        return F.array_min(F.filter(got, lambda x: x.isNotNull()))["letter"]

    bracket = last(lambda o: F.concat(F.lit("("), o["letter"], F.lit(")")), False)
    lone = last(lambda o: F.concat(F.lit(" "), o["letter"], F.lit(" ")), False)
    content = last(lambda o: F.lower(o["answer"]), True)
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    drawn = F.get(options, F.pmod(F.xxhash64(F.lit(seed), text), F.size(options)).cast("int"))["letter"]
    return F.coalesce(bracket, lone, F.when(words > 5, content), drawn)
