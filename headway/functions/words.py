"""Text columns of place search: folding, romanisation, house numbers, names and their context."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The official romanisation, its letters that differ at a word's start, and what people type instead.
LETTERS = {
    "а": "a", "б": "b", "в": "v", "г": "h", "ґ": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "y", "і": "i", "к": "k",
    "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts",
    "ч": "ch", "ш": "sh", "щ": "shch", "ь": "", "'": "", "’": "", "ʼ": "", "ы": "y", "э": "e", "ъ": "", "ё": "e",
}
STARTS = {"є": ("ye", "ie"), "ї": ("yi", "i"), "й": ("y", "i"), "ю": ("yu", "iu"), "я": ("ya", "ia")}
TYPED = {"г": "g", "и": "i", "х": "h", "ц": "c", "щ": "sch", "є": "ye", "ї": "i", "й": "y", "ю": "yu", "я": "ya"}
#: Letters that look alike in both alphabets.
ALIKE = ("аеіорсух", "aeiopcyx")


@F.pandas_udf(StringType())
def _bare(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x.casefold()) if not unicodedata.combining(c)))


def folded(text: Column) -> Column:
    """Case folded, without combining marks, ł as l. Spark has no decomposition, so an Arrow batch at a time does it."""
    return F.replace(_bare(text), F.lit("ł"), F.lit("l"))


def _mapped(text: Column, letters: dict[str, str]) -> Column:
    one = {a: b for a, b in letters.items() if len(b) == 1}
    for a, b in letters.items():
        if len(b) > 1:
            text = F.replace(text, F.lit(a), F.lit(b))
    # letters without a partner, at the end, are dropped
    return F.translate(text, "".join([*one, *(a for a, b in letters.items() if not b)]), "".join(one.values()))


def romanised(text: Column) -> Column:
    """The official scheme: some letters differ at a word's start, and зг is told from ж."""
    text = F.replace(F.lower(text), F.lit("зг"), F.lit("zgh"))
    for a, (first, _) in STARTS.items():
        text = F.regexp_replace(text, rf"(?<!\p{{L}}){a}", first)
    return _mapped(text, LETTERS | {a: b for a, (_, b) in STARTS.items()})


def typed(text: Column) -> Column:
    return _mapped(F.lower(text), LETTERS | TYPED)


def cyrillic(text: Column) -> Column:
    return text.rlike(r"[Ѐ-ӿ]")


def romanisations(text: Column) -> Column:
    """The different romanisations of a Cyrillic name, the official one first."""
    both = F.array_distinct(F.transform(F.array(romanised(text), typed(text)), lambda x: F.trim(x)))
    return F.when(cyrillic(text), F.filter(both, lambda x: (x != "") & (x != F.lower(text)))).otherwise(F.array().cast("array<string>"))


def number_key(folded_text: Column) -> Column:
    """What two spellings of a house number have in common; takes folded text."""
    return F.regexp_replace(F.translate(folded_text, *ALIKE), "[^0-9a-zа-яіїєґ]", "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


#: A street, then the run of words at the end that start with a digit, with a single letter behind them.
_NUMBER = r"^(.+?)((?: [0-9][^ ]*)+(?: [^0-9 ])?)$"
_ONLY = r"^[0-9][^ ]*( [0-9][^ ]*)*( [^0-9 ])?$"


def street_and_number(folded_text: Column) -> tuple[Column, Column]:
    """The words before a house number at the end, and its key; the key is empty if there is none, or nothing else."""
    line = F.array_join(words(folded_text), " ")
    has = line.rlike(_NUMBER) & ~line.rlike(_ONLY)
    street = F.when(has, F.regexp_extract(line, _NUMBER, 1)).otherwise(line)
    return street, F.when(has, number_key(F.regexp_extract(line, _NUMBER, 2))).otherwise("")


def name_and_context(display: Column) -> tuple[Column, Column]:
    """The name before the bracket, and the parts between commas inside it."""
    at = F.locate(" (", display)
    inner = F.substring(display, at + 2, F.length(display) - at - 2)
    parts = F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(at == 0, display).otherwise(F.substring(display, F.lit(1), at - 1)), F.when(at == 0, F.array().cast("array<string>")).otherwise(parts)


def area(category: Column) -> Column:
    return category.startswith("place=") | category.startswith("boundary=administrative")


def username(name: Column) -> Column:
    """Lower case and trimmed, or null where it is not a name; takes names whose compatibility forms are already composed."""
    name = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.when(name.rlike(r"^[a-z0-9][a-z0-9._-]{1,30}[a-z0-9]$"), name)
