"""Column functions over recognised text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linework.config import CONFIG
from linework.functions.distance import text_edits, word_edits

#: White space, quote marks and signs that patterns name.
WHITE = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: One sign of WHITE, or one of WHITE and the dot, for Java's patterns: signs of one byte are told by a table of bits, others are tried one by one.
_LOW, _HIGH = r"\t\n\x0B\f\r\x1C\x1D\x1E\x1F \x85\xA0", r"[[^\x00-\xFF]&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"
BLANK, BLANK_OR_DOT = f"[{_LOW}{_HIGH}]", f"[{_LOW}.{_HIGH}]"
#: WHITE's signs themselves.
BLANKS = "".join(chr(c) for c in (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
NOISE_PREFIX = rf'^["#\x{{201C}}\x{{201D}}\x{{2018}}\x{{2019}}{WHITE}]*(?:Ell[{WHITE}]+)?'
NOISE_SUFFIX = rf"[{WHITE}.]{{2,}}$"
PLACEHOLDER = r"\[illegible[^\]]*\]"
WORD_PARTS = r"^([^a-zA-Z]*)([a-zA-Z']+)([^a-zA-Z]*)$"
WORD_START = "Ġ"
SPECIALS = ("<pad>", "<bos>", "<eos>", "<unk>")
PAD, BOS, EOS, UNK = range(4)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, also inside lambdas that take it many times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column | str) -> Column:
    """text without white space at either end, of all of Unicode."""
    return F.btrim(col(text), F.lit(BLANKS))


def split_words(text: Column | str) -> Column:
    """Words between white space; none for blank text."""
    return F.filter(F.split(col(text), rf"{BLANK}+"), lambda x: x != "")


def clean_noise(text: Column | str) -> Column:
    """text without leading marks, trailing runs of dots and repeated spaces. One trailing dot stays."""
    out = F.regexp_replace(col(text), NOISE_PREFIX, "")
    # The last two signs tell whether the text ends in such a run, so that no pattern walks it.
    out = F.when(F.substring(out, -2, 2).rlike(rf"^{BLANK_OR_DOT}{{2}}\z"), F.rtrim(out, F.lit(BLANKS + "."))).otherwise(out)
    return strip(F.regexp_replace(out, "  +", " "))


#: Lines up to this length are compared cell by cell in the JVM; longer ones go to the Arrow kernel, whose result is the same and whose time is linear.
SHORT_LINE = 64


def edit_distance(a: Column | str, b: Column | str) -> Column:
    """Edits of code points that turn a into b."""
    a, b = col(a), col(b)
    short = (F.length(a) <= SHORT_LINE) & (F.length(b) <= SHORT_LINE)
    return F.coalesce(F.when(short, F.levenshtein(a, b)), text_edits(F.when(~short, a), F.when(~short, b)))


def quick_cer(a: Column | str, b: Column | str) -> Column:
    """Edits over the length of b; 1 where b is empty."""
    a, b = col(a), col(b)
    return F.when(F.length(b) == 0, 1.0).otherwise(edit_distance(a, b) / F.length(b))


def word_distance(a: Column, b: Column) -> Column:
    """Edits of whole words that turn one array into the other."""
    return word_edits(a, b)


def correctable(core: Column, whitelist: Column | None = None) -> Column:
    """Whether a word's letters may be corrected: three or more, not capitalised, not listed."""
    first = F.substring(core, 1, 1)
    ok = (F.length(core) >= 3) & ~((first == F.upper(first)) & (first != F.lower(first)))
    return ok if whitelist is None else ok & ~F.array_contains(whitelist, F.lower(core))


def keyword_hit(text: Column | str, keyword: Column | str) -> Column:
    """Whether lower-cased text has the lower-cased, stripped keyword; blank keywords hit nothing."""
    key = strip(F.lower(F.lit(keyword) if isinstance(keyword, str) else keyword))
    return (key != "") & F.contains(F.lower(col(text)), key)


def word_overlap(reference: Column | str, prediction: Column | str) -> Column:
    """Share of the reference's distinct lower-case words that the prediction has; 1 where there are none."""
    r, p = F.array_distinct(split_words(F.lower(col(reference)))), split_words(F.lower(col(prediction)))
    return F.when(F.size(r) == 0, 1.0).otherwise(F.size(F.array_intersect(r, p)) / F.size(r))


def joined_words(words: Column | str) -> Column:
    return F.array_join(col(words), " ")


def character_vocabulary(extra: str = "") -> dict[str, int]:
    """Special ids, then the printable ASCII characters in order, then any others."""
    chars = [chr(c) for c in range(32, 127)] + [c for c in dict.fromkeys(extra) if not 32 <= ord(c) < 127]
    return {name: i for i, name in enumerate((*SPECIALS, *chars))}


def encode_characters(text: Column | str, vocabulary: Column, bos: bool = True, eos: bool = True) -> Column:
    """Ids of text's characters by a map column; characters that it lacks are UNK."""
    body = F.transform(F.filter(F.split(col(text), ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(vocabulary, c), F.lit(UNK)))
    return F.concat(*([F.array(F.lit(BOS))] if bos else []), body, *([F.array(F.lit(EOS))] if eos else []))


def decode_characters(ids: Column | str, inverse: Column) -> Column:
    """Text of ids by an id-to-character map: up to EOS, without special ids."""
    ids = col(ids)
    end = F.array_position(ids, EOS).cast("int")
    body = F.when(end > 0, F.slice(ids, F.lit(1), F.greatest(end - 1, F.lit(0)))).otherwise(ids)
    return F.array_join(F.transform(F.filter(body, lambda x: x > UNK), lambda x: F.coalesce(F.try_element_at(inverse, x), F.lit(""))), "")


def resized(width: Column | str, height: Column | str) -> Column:
    """struct(width, height) that a page is brought to: shrunk if too long, grown if too narrow, else as it is."""
    c = CONFIG.preprocessing
    w, h = col(width), col(height)
    longest, shortest = F.greatest(w, h), F.least(w, h)
    grow = F.least(c.min_resize_side / shortest, c.max_side / longest)
    scale = F.when(longest > c.max_side, c.max_side / longest).when((shortest < c.min_resize_side) & (grow > c.grow_from), grow).otherwise(F.lit(1.0))
    return F.struct((w * scale).cast("int").alias("width"), (h * scale).cast("int").alias("height"))
