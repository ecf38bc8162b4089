"""Text rules as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that each rule counts as Chinese, Japanese or Korean; the rules differ.
SEARCH_CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}"
TOKEN_CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}"
LANGUAGE_CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FFFF}\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9D}"
WIDE = r"\x{2E80}-\x{9FFF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FF00}-\x{FF60}"
SENTENCE_ENDS = "。？！?!"


_SIGNS = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), TOKEN_CJK)
CJK_SIGNS, OTHER_WORDS = regex.compile(f"[{_SIGNS}]"), regex.compile(rf"(?V1)[[\p{{Alphabetic}}\p{{N}}]--[{_SIGNS}]]+")


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def clock(seconds: Column) -> Column:
    """Whole seconds as m:ss, or h:mm:ss from an hour on."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("int")
    short = F.format_string("%d:%02d", (s / 60).cast("int"), s % 60)
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", (s / 3600).cast("int"), ((s % 3600) / 60).cast("int"), s % 60)).otherwise(short)


def long_clock(seconds: Column) -> Column:
    """Whole seconds as mm:ss, or h:mm:ss from an hour on."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("int")
    return F.when(s >= 3600, clock(s)).otherwise(F.format_string("%02d:%02d", (s / 60).cast("int"), s % 60))


def seconds_of(text: Column) -> Column:
    """m:ss or h:mm:ss as seconds; null if the text isn't of that form."""
    part = lambda k: F.regexp_extract(text, r"^(?:(\d+):)?(\d+):(\d\d)$", k)
    number = lambda k: F.coalesce(F.nullif(part(k), F.lit("")).cast("int"), F.lit(0))
    return F.when(text.rlike(r"^(?:\d+:[0-5]?\d:[0-5]\d|\d+:[0-5]\d)$"), number(1) * 3600 + number(2) * 60 + number(3))


def lenient_seconds(text: Column) -> Column:
    """Seconds of a note's time however it is written: its parts that are numbers, as h:m:s or m:s; 0 where they are neither two nor three."""
    n = F.filter(F.transform(F.split(text, ":"), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    part = lambda k: F.get(n, F.lit(k))
    return F.when(F.size(n) == 3, part(0) * 3600 + part(1) * 60 + part(2)).when(F.size(n) == 2, part(0) * 60 + part(1)).otherwise(0.0)


def subtitle_clock(seconds: Column, separator: str) -> Column:
    """hh:mm:ss and milliseconds, rounded."""
    ms = F.greatest(F.lit(0), F.round(seconds * 1000)).cast("long")
    return F.format_string(f"%02d:%02d:%02d{separator}%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def lyric_clock(seconds: Column) -> Column:
    """mm:ss.cc, cut to centiseconds."""
    cs = F.floor(F.greatest(F.lit(0.0), seconds) * 100)
    return F.format_string("%02d:%02d.%02d", F.floor(cs / 6000), F.floor(cs / 100) % 60, cs % 100)


def clean(text: Column) -> Column:
    """Without bracketed sound tags and leading Chinese fillers; white space collapsed."""
    text = F.regexp_replace(text, r"\[[A-Za-z][A-Za-z _-]*\]", "")
    text = F.regexp_replace(text, r"(?:^|(?<=[，。！？、\s]))[嗯啊呃]+[，。、]?", "")
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^ +| +$", "")


def fold(text: Column, simplified: dict[str, str] | None = None) -> Column:
    """Lower case, and the simplified form of characters by a table."""
    text = F.lower(text)
    return F.translate(text, "".join(simplified), "".join(simplified.values())) if simplified else text


def terms(text: Column) -> Column:
    """Search terms in order: overlapping pairs of CJK runs (a lone character stands for itself), and other runs of letters and digits."""
    runs = F.regexp_extract_all(text, F.lit(rf"[{SEARCH_CJK}]+|[\p{{IsAlphabetic}}\p{{N}}&&[^{SEARCH_CJK}]&&[\x{{0}}-\x{{FFFF}}]]+"), F.lit(0))
    paired = lambda run: F.when(
        run.rlike(f"^[{SEARCH_CJK}]") & (F.char_length(run) > 1), F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(run) - 1)), lambda k: F.substring(run, k, F.lit(2)))
    ).otherwise(F.array(run))
    # Most texts need no classes of characters: what splits them is chosen by what they hold
    other = text.rlike(rf"[{SEARCH_CJK}\x{{10000}}-\x{{10FFFF}}]")
    plain = F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.when(~text.rlike(r"[^\x00-\x7F]"), plain).when(other, F.flatten(F.transform(runs, paired))).otherwise(simple_terms(text))


def has_all(text: Column, words: Column) -> Column:
    """Whether a text has every word of an array, anywhere in it. Both are folded."""
    return F.forall(words, lambda w: F.contains(text, w))


def simple_terms(text: Column) -> Column:
    """terms() of texts that are known to have no CJK characters: without the step that pairs them."""
    return F.regexp_extract_all(text, F.lit(r"[\p{IsAlphabetic}\p{N}]+"), F.lit(0))


def token_estimate(text: Column) -> Column:
    """Tokens without a tokenizer: one for a CJK character, four thirds for another word."""
    words = count(text, rf"[\p{{IsAlphabetic}}\p{{N}}&&[^{TOKEN_CJK}]]+")
    return count(text, f"[{TOKEN_CJK}]") + F.floor((words * 4 + 2) / 3).cast("int")


def estimated(text: str) -> int:
    """token_estimate() of a string."""
    cjk = len(CJK_SIGNS.findall(text))
    return cjk + (len(OTHER_WORDS.findall(text)) * 4 + 2) // 3


def width(text: Column) -> Column:
    """Cells on a display: two for wide characters."""
    return F.char_length(text) + count(text, f"[{WIDE}]")


def pairs(text: Column) -> Column:
    """Distinct character pairs."""
    n = F.char_length(text)
    return F.when(n >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.substring(text, k, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def similar(a: Column, b: Column) -> Column:
    """Share of character pairs in common."""
    return F.size(F.array_intersect(pairs(a), pairs(b))) / F.greatest(F.lit(1), F.size(F.array_union(pairs(a), pairs(b))))


def snippet(text: Column, found: Column) -> Column:
    """The text from 24 characters before the first place of a string on."""
    at = F.instr(text, found)
    return F.when(at > 25, F.concat(F.lit("…"), text.substr(at - 24, F.char_length(text)))).otherwise(text)


def title_cut(text: Column) -> Column:
    """At most 40 characters; with spaces up to 60, longer ones cut at the last space."""
    cut = F.regexp_replace(F.regexp_extract(text.substr(1, 61), r"(?s)^(.*) ", 1), r"[,;:\- ]+$", "")
    return F.when(F.char_length(text) <= 40, text).when(~F.contains(text, F.lit(" ")), text.substr(1, 40)).when(F.char_length(text) <= 60, text).otherwise(cut)


def clean_prose(text: Column, stop: str, least: int = 20) -> Column:
    """A reply as prose: what is before the end mark, single spaces, no headings or bullets, paragraphs apart; one without the mark ends with its
    last whole sentence; null if little is left."""
    ended = F.contains(text, F.lit(stop))
    body = F.regexp_replace(F.regexp_replace(F.substring_index(text, stop, 1), r"(?<=\S)[ \t]{2,}(?=\S)", " "), r"[ \t]+([。，、；：！？.,;:!?])", "$1")
    lines = F.transform(F.split(body, r"\R"), lambda x: F.trim(F.regexp_replace(F.trim(x), "^#", "")))
    whole = F.array_join(F.filter(lines, lambda x: ~x.rlike(r"^[-*]|^$")), "\n\n")
    sentence = F.regexp_extract(whole, r"(?s)^(.*(?:[。！？!?](?:\s*\[\d+:\d{2}(?::\d{2})?\])?|\.(?=\s|$)))", 1)
    kept = F.when(ended | (sentence == ""), whole).otherwise(F.trim(sentence))
    return F.when(F.char_length(kept) >= least, kept)


def escape_markup(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def one_cue(text: Column) -> Column:
    """A text for a cue: no blank lines, ends trimmed."""
    return F.regexp_replace(F.regexp_replace(text, r"\n\s*\n+", "\n"), r"^\s+|\s+$", "")


def file_name(text: Column) -> Column:
    return F.regexp_replace(text, r'[/\\:*?"<>|\x00-\x1f]+', "-")


def duration_text(seconds: Column) -> Column:
    """A number of seconds as a clock; anything else as it stands."""
    return F.when(seconds.rlike(r"^\d+$"), clock(seconds.try_cast("int"))).otherwise(seconds)


def url_extension(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"\.([A-Za-z0-9]{1,4})(?:[?#].*)?$", 1), F.lit(""))


def anchors(text: Column) -> Column:
    """Times in brackets, in order; a bracket may list several."""
    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+:\d\d(?::\d\d)?(?:\s*,\s*\d+:\d\d(?::\d\d)?)*)\]"), F.lit(1)), lambda x: F.split(x, r"\s*,\s*")))


def edit_tokens(text: Column) -> Column:
    """Tokens that an editor moves: a Han character or a word, with the signs and spaces after it; together they are the text."""
    return F.regexp_extract_all(text, F.lit(r"(?:^[^\p{L}\p{N}]+)?(?:[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]|[\p{L}\p{N}&&[^\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]]+)[^\p{L}\p{N}]*|^[^\p{L}\p{N}]+$"), F.lit(0))


def email_key(address: Column) -> Column:
    """What two spellings of an address share: the domain's case doesn't matter."""
    return F.concat(F.substring_index(address, "@", 1), F.lit("@"), F.lower(F.substring_index(address, "@", -1)))


def is_email(address: Column) -> Column:
    """Whether mail can go there: one at-sign, no blanks, a dotted domain, lengths within the standard's."""
    return (
        address.rlike(r"^[^@\s]{1,64}@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$") & (F.char_length(address) <= 254) & ~address.rlike(r"^\.|\.\.|\.@|@-|-\.|-$")
    )


def name_key(name: Column, fold_script=lambda c: c) -> Column:
    """What two spellings of a name share: full-width signs as plain ones, lower case, single spaces."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000"
    plain = "".join(map(chr, range(0x21, 0x7F))) + " "
    narrow = F.when(name.rlike(r"[\x{FF01}-\x{FF5E}\x{3000}]"), F.translate(name, wide, plain)).otherwise(name)
    return F.trim(F.regexp_replace(F.lower(fold_script(narrow)), r"\s+", " "))


def is_person_name(name: Column) -> Column:
    """Not blank, and not a label like "Speaker 2"."""
    return (F.trim(name) != "") & ~F.trim(name).rlike(r"(?i)^(speaker|語者|语者|說話人|说话人|說話者|说话者)\s*\d+$")


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(text: Column) -> Column:
    """Compatibility forms as plain ones; ASCII texts don't leave the JVM for it."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(text)).otherwise(text)


def email_plain(address: Column) -> Column:
    """An address as typed: compatibility forms plain, no blanks at its ends, lower case."""
    return F.lower(F.trim(nfkc(address)))


def fnv1a64(text: Column) -> Column:
    """The FNV-1a hash of a text's bytes in UTF-8, as 16 hexadecimal digits. The product is put together from halves, so nothing overflows."""
    low, high = (1 << 32) - 1, lambda h: F.shiftrightunsigned(h, 32)
    octets = F.transform(F.filter(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1)), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long"))

    def step(h: Column, octet: Column) -> Column:
        h = h.bitwiseXOR(octet)
        below = h.bitwiseAND(F.lit(low)) * 0x1B3
        above = (high(h) * 0x1B3 + high(below) + F.shiftleft(h.bitwiseAND(F.lit((1 << 24) - 1)), 8)).bitwiseAND(F.lit(low))
        return F.shiftleft(above, 32).bitwiseOR(below.bitwiseAND(F.lit(low)))

    return F.lpad(F.hex(F.aggregate(octets, F.lit(0xCBF29CE484222325 - (1 << 64)).cast("long"), step)), 16, "0")


# Signs that end what another speaker said when a piece begins with them, and sentence ends.
LEADING, PIECE_ENDS = "，。、？！；：,.?!;: ", "。？！.?!"


def leading_marks(text: Column) -> Column:
    """The punctuation and spaces that a text begins with."""
    return F.regexp_extract(text, f"^[{LEADING}]*", 0)


def ends_sentence(text: Column) -> Column:
    return F.rtrim(text).rlike(f"[{PIECE_ENDS}]$")


def chunk_line(text: Column, name: Column) -> Column:
    """A line as it stands in a passage: with the speaker's name, if there is one."""
    return F.when(F.coalesce(F.trim(name), F.lit("")) != "", F.concat(name, F.lit(": "), text)).otherwise(text)


def kept_title(title: Column, first_line: Column, placeholders: list[str]) -> Column:
    """A title that somebody gave: not blank, no placeholder, not the first line's first 20 characters; else null."""
    own = F.trim(title)
    return F.when((own != "") & ~own.isin(*placeholders) & F.coalesce(own != F.substring(first_line, 1, 20), F.lit(True)), own)


def answer_language(characters: Column, words: Column, ui: str, least: int = 4) -> Column:
    """The language that a question is answered in: its own, where it has ``least`` Latin words or CJK characters (Chinese in the interface's
    script, if that is Chinese, else in traditional characters); the interface's otherwise."""
    chinese = ui if ui.startswith("zh") else "zh-Hant"
    return F.when(characters + words < least, ui).when(words > characters, "en").otherwise(chinese)
